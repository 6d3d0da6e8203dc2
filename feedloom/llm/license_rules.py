"""Signature rules of the license scan, and the table they expand to.

A rule is a regex over whole lower-case words separated by one space, so it never starts or ends inside a word. Its
keyword is a word or phrase that every match contains: a text without it isn't searched. The kinds, in order of
priority: ``text`` is a sentence of a license's own wording, ``notice`` a statement that a license applies, ``name`` a
license's name with its version, ``mention`` a bare name or abbreviation.
"""

from __future__ import annotations

from typing import NamedTuple

KINDS = ("text", "notice", "name", "mention")
SCORES = {"text": 1.0, "notice": 0.9, "name": 0.75, "mention": 0.5}


class Rule(NamedTuple):
    rule_id: int
    priority: int
    label: str
    kind: str
    keyword: str
    pattern: str


V2, V21, V3 = r"(v2|v?2 0|version 2( 0)?)", r"(v2 1|2 1|version 2 1)", r"(v3|v?3 0|version 3( 0)?)"
LATER = r"( or( at your option)? (any )?later( version)?| or newer)"

# (label, kind, keyword, pattern)
HAND_WRITTEN = [
    # MIT and X11
    ("mit", "text", "free of charge", r"permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("mit", "text", "without restriction", r"to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense"),
    ("mit", "text", "noninfringement", r"merchantability fitness for a particular purpose and noninfringement"),
    ("mit", "text", "permission notice", r"the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"),
    ("mit", "notice", "mit license", r"(released|licensed|distributed|available|provided|published) under (the )?(terms of the )?mit license"),
    ("mit", "notice", "mit", r"under the mit license"),
    ("mit", "notice", "mit", r"license mit"),
    ("mit", "notice", "mit", r"licensed mit"),
    ("mit", "name", "mit", r"the mit license( mit)?"),
    ("mit", "name", "mit", r"mit licen[sc]e"),
    ("mit", "name", "mit", r"mit style licen[sc]e"),
    ("mit", "name", "expat", r"expat licen[sc]e"),
    ("mit", "mention", "mit licensed", r"mit licensed"),
    ("mit-0", "name", "mit", r"mit (no attribution|0)( license)?"),
    ("x11", "name", "x11", r"x11 licen[sc]e"),
    ("x11", "text", "x consortium", r"except as contained in this notice the name of the x consortium shall not be used"),
    # Apache
    ("apache-2", "text", "apache license", r"licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license"),
    ("apache-2", "text", "apache org", r"you may obtain a copy of the license at https? www apache org licenses license 2 0"),
    ("apache-2", "text", "as is basis", r"distributed under the license is distributed on an as is basis without warranties or conditions of any kind"),
    ("apache-2", "notice", "apache license", r"(released|licensed|distributed|available|provided|published) under (the )?(terms of the )?apache license( version)? 2( 0)?"),
    ("apache-2", "notice", "apache", r"license apache( license)? " + V2),
    ("apache-2", "name", "apache license version 2", r"apache license version 2( 0)?"),
    ("apache-2", "name", "apache", r"apache( software)? license " + V2),
    ("apache-2", "name", "apache", r"apache " + V2 + r"( license)?"),
    ("apache-2", "mention", "apache2", r"apache2"),
    ("apache-2", "mention", "asl", r"asl " + V2),
    ("apache-1.1", "name", "apache", r"apache( software)? license (version )?1 1"),
    ("apache-1.0", "name", "apache", r"apache( software)? license (version )?1 0"),
    ("apache", "mention", "apache license", r"apache license"),
    # GNU
    ("gpl", "text", "general public license", r"this program is free software you can redistribute it and or modify it under the terms of the gnu general public license"),
    ("gpl", "text", "general public license", r"you should have received a copy of the gnu general public license along with this program"),
    ("lgpl", "text", "general public license", r"under the terms of the gnu (lesser|library) general public license"),
    ("agpl", "text", "affero", r"under the terms of the gnu affero general public license"),
    ("gpl-2", "notice", "general public license", r"(licensed|released|distributed) under (the )?(terms of the )?(gnu )?general public license " + V2),
    ("gpl-3", "notice", "general public license", r"(licensed|released|distributed) under (the )?(terms of the )?(gnu )?general public license " + V3),
    ("gpl-2-or-later", "name", "general public license", r"gnu general public license " + V2 + LATER),
    ("gpl-3-or-later", "name", "general public license", r"gnu general public license " + V3 + LATER),
    ("gpl-2-only", "name", "general public license", r"gnu general public license " + V2 + r" only"),
    ("gpl-3-only", "name", "general public license", r"gnu general public license " + V3 + r" only"),
    ("gpl-2", "name", "general public license", r"(gnu )?general public license " + V2),
    ("gpl-3", "name", "general public license", r"(gnu )?general public license " + V3),
    ("gpl-1", "name", "general public license", r"(gnu )?general public license (v1|version 1)"),
    ("lgpl-2", "name", "general public license", r"gnu library general public license " + V2),
    ("lgpl-2.1", "name", "general public license", r"gnu lesser general public license " + V21),
    ("lgpl-3", "name", "general public license", r"gnu lesser general public license " + V3),
    ("agpl-3", "name", "affero", r"gnu affero general public license " + V3),
    ("gpl", "mention", "general public license", r"(gnu )?general public license"),
    ("lgpl", "mention", "general public license", r"(gnu )?(lesser|library) general public license"),
    ("agpl", "mention", "affero", r"(gnu )?affero general public license"),
    ("gpl-2-or-later", "name", "gpl", r"(gnu )?gpl " + V2 + LATER),
    ("gpl-3-or-later", "name", "gpl", r"(gnu )?gpl " + V3 + LATER),
    ("gpl-2-or-later", "name", "gplv2", r"(gnu )?gplv2" + LATER),
    ("gpl-3-or-later", "name", "gplv3", r"(gnu )?gplv3" + LATER),
    ("gpl-2", "mention", "gplv2", r"(gnu )?gplv2"),
    ("gpl-3", "mention", "gplv3", r"(gnu )?gplv3"),
    ("gpl-2", "name", "gpl", r"(gnu )?gpl " + V2),
    ("gpl-3", "name", "gpl", r"(gnu )?gpl " + V3),
    ("gpl", "mention", "gpl", r"(gnu |under the |licensed )gpl"),
    ("lgpl-2.1", "name", "lgpl", r"(gnu )?lgpl " + V21),
    ("lgpl-2", "name", "lgpl", r"(gnu )?lgpl " + V2),
    ("lgpl-3", "name", "lgpl", r"(gnu )?lgpl " + V3),
    ("lgpl-3", "mention", "lgplv3", r"(gnu )?lgplv3"),
    ("lgpl", "mention", "lgpl", r"(gnu |under the |licensed )lgpl"),
    ("agpl-3", "name", "agpl", r"(gnu )?agpl " + V3),
    ("agpl-3", "mention", "agplv3", r"(gnu )?agplv3"),
    ("agpl", "mention", "agpl", r"(gnu |under the |licensed )agpl"),
    ("gfdl", "text", "free documentation license", r"permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation license"),
    ("gfdl", "name", "free documentation license", r"(gnu )?free documentation license( version 1 [123])?"),
    ("gfdl", "mention", "gfdl", r"gfdl( 1 [123])?"),
    # BSD and the like
    ("bsd", "text", "source and binary forms", r"redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("bsd-3-clause", "text", "endorse or promote", r"may be used to endorse or promote products derived from this software without specific prior written permission"),
    ("bsd-4-clause", "text", "advertising materials", r"all advertising materials mentioning features or use of this software must display the following acknowledg(e)?ment"),
    ("bsd", "text", "source code must retain", r"redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer"),
    ("bsd", "text", "binary form must", r"redistributions in binary form must reproduce the above copyright notice"),
    ("bsd", "notice", "bsd", r"(released|licensed|distributed|available) under (the )?(a )?(terms of the )?(new |modified |simplified |revised )?bsd( style)? license"),
    ("bsd-2-clause", "name", "bsd", r"((2|two) clause|simplified|freebsd) bsd( license)?"),
    ("bsd-3-clause", "name", "bsd", r"((3|three) clause|new|modified|revised) bsd( license)?"),
    ("bsd-4-clause", "name", "bsd", r"((4|four) clause|original|old) bsd( license)?"),
    ("bsd-2-clause", "name", "bsd", r"bsd (2|two) clause( license)?"),
    ("bsd-3-clause", "name", "bsd", r"bsd (3|three) clause( license)?"),
    ("bsd-4-clause", "name", "bsd", r"bsd (4|four) clause( license)?"),
    ("0bsd", "mention", "0bsd", r"0bsd( license)?"),
    ("0bsd", "name", "bsd", r"(zero|0) clause bsd( license)?"),
    ("bsd", "mention", "bsd", r"bsd( style)? licen[sc]ed?"),
    ("isc", "text", "for any purpose", r"permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("isc", "name", "isc", r"isc licen[sc]e"),
    ("isc", "notice", "isc", r"licensed under (the )?isc"),
    ("zlib", "text", "as is", r"this software is provided as is without any express or implied warranty in no event will the authors be held liable"),
    ("zlib", "text", "altered source", r"altered source versions must be plainly marked as such"),
    ("zlib", "name", "zlib", r"zlib( libpng)? licen[sc]e"),
    ("bsl-1", "text", "boost", r"boost software license version 1 0 august 17th 2003"),
    ("bsl-1", "name", "boost", r"boost( software)? license( version)?( 1 0)?"),
    ("ncsa", "name", "ncsa", r"(university of illinois )?ncsa( open source)? license"),
    ("openssl", "name", "openssl", r"openssl( and ssleay)? license"),
    ("curl", "name", "curl", r"curl license"),
    ("libpng", "name", "libpng", r"libpng license( version 2)?"),
    ("ftl", "name", "freetype", r"freetype( project)? license"),
    ("ijg", "name", "jpeg group", r"independent jpeg group( license)?"),
    ("icu", "name", "icu", r"icu license"),
    ("unicode", "name", "unicode", r"unicode( data files and software)? license"),
    ("postgresql", "name", "postgresql", r"postgresql licen[sc]e"),
    ("ntp", "name", "ntp", r"ntp license"),
    ("hpnd", "name", "permission notice", r"historical permission notice and disclaimer"),
    ("wtfpl", "text", "public license", r"do what the fuck you want to public license"),
    ("wtfpl", "mention", "wtfpl", r"wtfpl( version 2)?"),
    ("beerware", "name", "beerware", r"beerware license"),
    ("beerware", "text", "buy me a beer", r"you can buy me a beer in return"),
    ("json", "text", "good not evil", r"the software shall be used for good not evil"),
    ("unlicense", "text", "public domain", r"this is free and unencumbered software released into the public domain"),
    ("unlicense", "name", "unlicense", r"(the )?unlicense"),
    ("unlicense", "notice", "unlicense org", r"for more information please refer to https? unlicense org"),
    ("public-domain", "notice", "public domain", r"(released|placed|dedicated) (into|in|to) the public domain"),
    ("public-domain", "notice", "public domain", r"(this work|this file|this code|this software|it) is in the public domain"),
    ("public-domain", "mention", "public domain", r"public domain (software|work|dedication|notice)"),
    # Mozilla, Eclipse and other file-level copyleft
    ("mpl-2", "text", "mozilla", r"this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("mpl-2", "text", "mozilla", r"if a copy of the mpl was not distributed with this file you can obtain one at https? mozilla org mpl 2 0"),
    ("mpl-2", "name", "mozilla public license", r"mozilla public license (v |version )?2( 0)?"),
    ("mpl-1.1", "name", "mozilla public license", r"mozilla public license (v |version )?1 1"),
    ("mpl-1.0", "name", "mozilla public license", r"mozilla public license (v |version )?1 0"),
    ("mpl", "mention", "mozilla public license", r"mozilla public license"),
    ("mpl-2", "mention", "mpl", r"mpl (v |version )?2( 0)?"),
    ("mpl-1.1", "mention", "mpl", r"mpl (v |version )?1 1"),
    ("epl-2", "name", "eclipse", r"eclipse public license (v |version )?2( 0)?"),
    ("epl-1", "name", "eclipse", r"eclipse public license (v |version )?1( 0)?"),
    ("epl", "mention", "eclipse", r"eclipse public license"),
    ("epl-2", "mention", "epl", r"epl (v |version )?2( 0)?"),
    ("epl-1", "mention", "epl", r"epl (v |version )?1( 0)?"),
    ("edl-1", "name", "eclipse", r"eclipse distribution license( v| version)?( 1 0)?"),
    ("cddl-1.0", "name", "common development", r"common development and distribution license( cddl)?( version)? 1 0"),
    ("cddl-1.1", "name", "common development", r"common development and distribution license( cddl)?( version)? 1 1"),
    ("cddl", "mention", "common development", r"common development and distribution license"),
    ("cddl", "mention", "cddl", r"cddl( license)?( 1 [01])?"),
    ("cpl-1", "name", "common public license", r"common public license( version)?( 1 0)?"),
    ("ipl-1", "name", "ibm", r"ibm public license( version)?( 1 0)?"),
    ("apsl-2", "name", "apple", r"apple public source license( version)?( 2 0)?"),
    ("spl-1", "name", "sun public license", r"sun public license( version)?( 1 0)?"),
    ("npl-1.1", "name", "netscape", r"netscape public license( version)?( 1 [01])?"),
    ("osl-3", "name", "open software license", r"open software license( v| version)?( 3 0)?"),
    ("afl-3", "name", "academic free license", r"academic free license( v| version)?( 3 0)?"),
    ("ms-pl", "name", "microsoft public", r"microsoft public license( ms pl)?"),
    ("ms-rl", "name", "microsoft reciprocal", r"microsoft reciprocal license( ms rl)?"),
    ("eupl-1.2", "name", "european union", r"european union public licen[cs]e( eupl)?( v| version)?( 1 2)?"),
    ("eupl-1.2", "mention", "eupl", r"eupl( v)?( 1 2)?"),
    ("cecill-2.1", "name", "cecill", r"cecill( free software)?( license)?( agreement)?( v| version)? 2 1"),
    ("cecill", "mention", "cecill", r"cecill( b| c)?( license)?"),
    ("artistic-2", "name", "artistic", r"artistic license( version)? 2( 0)?"),
    ("artistic-1", "name", "artistic", r"artistic license( version)? 1( 0)?"),
    ("artistic", "mention", "artistic", r"artistic license"),
    ("artistic", "notice", "same terms as perl", r"under the same terms as perl( itself)?"),
    ("python-2", "name", "python", r"python( software foundation)? license( version)?( agreement)?( 2)?"),
    ("psf-2", "mention", "psf", r"psf license( version)?( 2)?"),
    ("php-3", "name", "php", r"php license( version)?( 3 0[01]?)?"),
    ("ruby", "name", "ruby", r"ruby license"),
    ("ruby", "notice", "same terms as ruby", r"under the same terms as ruby( itself)?"),
    ("vim", "name", "vim", r"vim license"),
    ("zend-2", "name", "zend", r"zend( engine)? license( version)?( 2 0)?"),
    ("w3c", "name", "w3c", r"w3c software( and document)?( notice and)? license"),
    ("ofl-1.1", "text", "open font", r"this font software is licensed under the sil open font license version 1 1"),
    ("ofl-1.1", "name", "open font", r"(sil )?open font license( version)?( 1 [01])?"),
    ("ofl-1.1", "mention", "ofl", r"(sil )?ofl( 1 1)?"),
    ("lppl-1.3", "name", "latex", r"latex project public license( version)?( 1 3[abc]?)?"),
    ("qpl-1", "name", "q public", r"q public license( version)?( 1 0)?"),
    ("sleepycat", "name", "sleepycat", r"sleepycat license"),
    ("upl-1", "name", "universal permissive", r"universal permissive license( v| version)?( 1 0)?"),
    ("mulan-2", "name", "mulan", r"mulan( permissive software)? (license|psl)( v2| version 2)?"),
    ("blueoak-1", "name", "blue oak", r"blue oak model license( version)?( 1 0 0)?"),
    ("odc-by", "name", "open data commons", r"open data commons attribution license"),
    ("odbl", "name", "open database", r"open database license( odbl)?( v| version)?( 1 0)?"),
    ("odbl", "mention", "odbl", r"odbl"),
    ("pddl", "name", "public domain dedication", r"public domain dedication and license( pddl)?"),
    # Restricted and commercial terms
    ("sspl-1", "name", "server side public", r"server side public license( v| version)?( 1)?"),
    ("sspl-1", "mention", "sspl", r"sspl( v1| 1 0)?"),
    ("busl-1.1", "name", "business source", r"business source license( v| version)?( 1 1)?"),
    ("elastic-2", "name", "elastic license", r"elastic license( v2| version 2| 2 0)?"),
    ("commons-clause", "text", "right to sell", r"the license does not grant to you the right to sell the software"),
    ("commons-clause", "name", "commons clause", r"commons clause( license)?( condition)?( v1 0)?"),
    ("polyform-nc", "name", "polyform", r"polyform noncommercial license( 1 0 0)?"),
    ("polyform", "mention", "polyform", r"polyform"),
    ("llama", "name", "llama", r"llama (2|3|3 1|3 2) community license( agreement)?"),
    ("openrail", "name", "openrail", r"(creativeml |bigscience |bigcode )?openrail( m)?( license)?"),
    ("proprietary", "notice", "all rights reserved", r"all rights reserved"),
    ("proprietary", "notice", "confidential", r"(proprietary and confidential|confidential and proprietary)"),
    ("proprietary", "notice", "unauthorized", r"unauthorized (copying|use|reproduction|distribution)( or distribution)? of this (file|software|program|document)"),
    ("proprietary", "notice", "unauthorised", r"unauthorised (copying|use|reproduction|distribution)( or distribution)? of this (file|software|program|document)"),
    ("proprietary", "notice", "license agreement", r"end user license agreement"),
    ("proprietary", "mention", "eula", r"eula"),
    ("proprietary", "notice", "written permission", r"without (the )?(express |prior )*written permission"),
    ("proprietary", "notice", "commercial license", r"commercial license (is )?(required|available)"),
    ("non-commercial", "notice", "commercial use", r"(for )?non commercial use only"),
    ("non-commercial", "notice", "noncommercial", r"(for )?noncommercial (use|purposes) only"),
    ("non-commercial", "notice", "academic", r"for academic (and research )?(use|purposes) only"),
    ("non-commercial", "notice", "research purposes", r"for research purposes only"),
    ("free-unclear", "mention", "freeware", r"freeware"),
    ("free-unclear", "mention", "shareware", r"shareware"),
    ("free-unclear", "mention", "freely", r"(may be )?freely (distributed|redistributed|distributable|redistributable|used)"),
    ("unspecified", "mention", "license", r"see (the )?license( file)?( for details)?"),
    ("unspecified", "mention", "licensed under", r"licensed under the same (terms|license)"),
    ("unspecified", "mention", "copyright", r"see (the )?copyright (file|notice)( for details)?"),
    # Creative Commons
    ("cc0-1", "text", "neighboring rights", r"has waived all copyright and related or neighboring rights"),
    ("cc0-1", "name", "cc0", r"cc0( license)?( 1 0)?( universal)?"),
    ("cc0-1", "name", "cc zero", r"cc zero"),
    ("cc0-1", "name", "creative commons", r"creative commons (zero|0)( v1 0)?( universal)?"),
    ("cc-by-nc", "notice", "cc by nc", r"cc by nc"),
    ("cc", "mention", "creative commons", r"creative commons( license)?"),
    ("cc", "notice", "creativecommons org", r"https? (www )?creativecommons org licenses"),
]

#: Rights of Creative Commons licenses: the label's letters, the words, and what either form may be.
CC_RIGHTS = {
    "by": "attribution", "by-sa": "attribution share( )?alike", "by-nd": "attribution no( )?deriv(ative)?s",
    "by-nc": "attribution non( )?commercial", "by-nc-sa": "attribution non( )?commercial share( )?alike",
    "by-nc-nd": "attribution non( )?commercial no( )?deriv(ative)?s",
}
CC_VERSIONS = {"1.0": "1 0", "2.0": "2 0", "2.5": "2 5", "3.0": "3 0", "4.0": "4 0"}


def _creative_commons():
    for letters, words in CC_RIGHTS.items():
        short, label = letters.replace("-", " "), f"cc-{letters}"
        yield label, "name", "creative commons", f"creative commons {words}( license)?( international| unported| generic)?"
        yield label, "mention", f"cc {short}", f"(license |licensed |under )cc {short}"
        yield label, "notice", "creativecommons org", f"creativecommons org licenses {short}"
        for version, text in CC_VERSIONS.items():
            yield f"{label}-{version}", "notice", f"cc {short}", f"cc {short} {text}( international| unported)?"
            yield f"{label}-{version}", "name", "creative commons", f"creative commons {words} {text}( international| unported| generic)?( public)?( license)?"
            yield f"{label}-{version}", "notice", "creativecommons org", f"creativecommons org licenses {short} {text}"


def _spdx():
    ids = (
        "mit 0bsd isc zlib unlicense wtfpl ncsa ofl-1.1 apache-2.0 bsd-2-clause bsd-3-clause mpl-2.0 epl-2.0 cddl-1.0 "
        "gpl-2.0-only gpl-2.0-or-later gpl-3.0-only gpl-3.0-or-later lgpl-2.1-only lgpl-2.1-or-later lgpl-3.0-only "
        "agpl-3.0-only agpl-3.0-or-later cc0-1.0 cc-by-4.0 cc-by-sa-4.0 cc-by-nc-4.0 bsl-1.0 artistic-2.0 eupl-1.2"
    )
    for name in ids.split():
        yield name.removesuffix(".0"), "notice", "spdx", "spdx license identifier " + name.replace("-", " ").replace(".", " ")


def rules() -> list[Rule]:
    """All rules in order; where spans are equal the earlier priority, then the earlier rule, wins."""
    rows = [*HAND_WRITTEN, *_creative_commons(), *_spdx()]
    return [Rule(i, KINDS.index(kind), label, kind, keyword, pattern) for i, (label, kind, keyword, pattern) in enumerate(rows)]


def spaced(words: str) -> str:
    """A phrase or regex for text in which every word has a space of its own on either side."""
    return " " + words.replace(" ", "  ") + " "
