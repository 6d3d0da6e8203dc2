"""The duplicate rule restated as a plain sequential pass, for small inputs."""

from __future__ import annotations

from difflib import SequenceMatcher


def alike(a: str, b: str) -> float:
    return SequenceMatcher(None, a, b).ratio() if a and b else 0.0


def is_duplicate(row, kept, threshold=0.85, hours=24, alone=0.95):
    title = alike(row["title"].lower(), kept["title"].lower())
    summary = alike(row["summary"].lower(), kept["summary"].lower())
    close = abs(row["at"] - kept["at"]) <= hours * 3_600_000_000
    same = bool(row["site"]) and row["site"] == kept["site"]
    return (title >= threshold and close) or (summary >= threshold and same) or title >= alone


def survivors(rows, scope="block", threshold=0.85, hours=24):
    """``rows``: dicts with ord, at (microseconds), link, url, site, fp, title, summary, and turn, the batch, if there are several.

    ``scope`` says where a similar kept row is looked for: in the row's fingerprint group, or anywhere.
    """
    kept, urls, prints = [], set(), set()
    for row in sorted(rows, key=lambda r: (r.get("turn", 0), -r["at"], r["ord"])):
        if not row["link"]:
            kept.append(row)
            continue
        if row["url"] in urls:
            continue
        if row["fp"] in prints:
            pool = kept if scope == "all" else [k for k in kept if k["link"] and k["fp"] == row["fp"]]
            if any(is_duplicate(row, k, threshold, hours) for k in pool):
                continue
        kept.append(row)
        urls.add(row["url"])
        prints.add(row["fp"])
    return {k["ord"] for k in kept}
