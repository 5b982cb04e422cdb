"""Signatures of licences: titles, short names, tags and typical sentences.

A signature is a regular expression over the lower-cased words of a text, a blank standing
for the gap between two words; punctuation is no word, so "GPL-2.0+" is ``gpl 2 0``.  Each
rule names a keyword, a word every match holds: rules whose keyword a text lacks are not
tried on it.  Rules are ordered by tier, the reliable kinds of evidence first.
"""

from __future__ import annotations

from typing import NamedTuple

TAG, SENTENCE, VERSIONED, TITLE, SHORT = range(1, 6)
CONFIDENCE = {TAG: 1.0, SENTENCE: 0.95, VERSIONED: 0.9, TITLE: 0.7, SHORT: 0.5}


class Rule(NamedTuple):
    rule: int
    tier: int
    label: str
    keyword: str
    signature: str


# Label, keyword, title, versions; a title also counts without a version.
FAMILIES = (
    ("gpl", "gnu", "gnu (?:general public licen[cs]e|gpl)", "1.0 2.0 3.0"),
    ("gpl", "general", "general public licen[cs]e", ""),
    ("lgpl", "lesser", "(?:gnu )?lesser general public licen[cs]e", "2.1 3.0"),
    ("lgpl", "library", "(?:gnu )?library general public licen[cs]e", "2.0"),
    ("agpl", "affero", "(?:gnu )?affero general public licen[cs]e", "1.0 3.0"),
    ("gfdl", "documentation", "(?:gnu )?free documentation licen[cs]e", "1.1 1.2 1.3"),
    ("apache", "apache", "apache(?: software)? licen[cs]e", "1.0 1.1 2.0"),
    ("mit", "mit", "mit licen[cs]e", ""),
    ("mit", "expat", "expat licen[cs]e", ""),
    ("mit", "x11", "x11 licen[cs]e", ""),
    ("mit-0", "attribution", "mit no attribution(?: licen[cs]e)?", ""),
    ("bsd", "bsd", "bsd(?: style)? licen[cs]e", ""),
    ("bsd-2-clause", "bsd", "(?:simplified bsd|bsd simplified)(?: licen[cs]e)?", ""),
    ("bsd-2-clause", "freebsd", "freebsd licen[cs]e", ""),
    ("bsd-2-clause", "clause", "(?:bsd (?:2|two) clause|(?:2|two) clause bsd)(?: licen[cs]e)?", ""),
    ("bsd-3-clause", "clause", "(?:bsd (?:3|three) clause|(?:3|three) clause bsd)(?: licen[cs]e)?", ""),
    ("bsd-3-clause", "bsd", "(?:new|modified|revised) bsd licen[cs]e", ""),
    ("bsd-4-clause", "clause", "(?:bsd (?:4|four) clause|(?:4|four) clause bsd)(?: licen[cs]e)?", ""),
    ("bsd-4-clause", "bsd", "(?:original|old) bsd licen[cs]e", ""),
    ("0bsd", "clause", "(?:bsd (?:0|zero) clause|(?:0|zero) clause bsd)(?: licen[cs]e)?", ""),
    ("mpl", "mozilla", "mozilla public licen[cs]e", "1.0 1.1 2.0"),
    ("npl", "netscape", "netscape public licen[cs]e", "1.0 1.1"),
    ("epl", "eclipse", "eclipse public licen[cs]e", "1.0 2.0"),
    ("edl", "eclipse", "eclipse distribution licen[cs]e", "1.0"),
    ("cpl", "common", "common public licen[cs]e", "0.5 1.0"),
    ("ipl", "ibm", "ibm public licen[cs]e", "1.0"),
    ("cddl", "distribution", "common development and distribution licen[cs]e", "1.0 1.1"),
    ("cpal", "attribution", "common public attribution licen[cs]e", "1.0"),
    ("eupl", "european", "european union public licen[cs]e", "1.0 1.1 1.2"),
    ("osl", "open", "open software licen[cs]e", "1.0 1.1 2.0 2.1 3.0"),
    ("afl", "academic", "academic free licen[cs]e", "1.1 1.2 2.0 2.1 3.0"),
    ("artistic", "artistic", "artistic licen[cs]e", "1.0 2.0"),
    ("psf", "python", "python software foundation licen[cs]e", "2.0"),
    ("python", "python", "python licen[cs]e", "2.0"),
    ("php", "php", "php licen[cs]e", "3.0 3.01"),
    ("ruby", "ruby", "ruby licen[cs]e", ""),
    ("zpl", "zope", "zope public licen[cs]e", "1.1 2.0 2.1"),
    ("apsl", "apple", "apple public source licen[cs]e", "1.0 1.1 1.2 2.0"),
    ("ofl", "sil", "sil open font licen[cs]e", "1.0 1.1"),
    ("ofl", "font", "open font licen[cs]e", ""),
    ("lppl", "latex", "latex project public licen[cs]e", "1.0 1.1 1.2 1.3"),
    ("cecill", "cecill", "cecill(?: free software)? licen[cs]e", "1.0 1.1 2.0 2.1"),
    ("bsl", "boost", "boost software licen[cs]e", "1.0"),
    ("busl", "business", "business source licen[cs]e", "1.1"),
    ("sspl", "server", "server side public licen[cs]e", "1.0"),
    ("rpl", "reciprocal", "reciprocal public licen[cs]e", "1.1 1.5"),
    ("ms-pl", "microsoft", "microsoft public licen[cs]e", ""),
    ("ms-rl", "microsoft", "microsoft reciprocal licen[cs]e", ""),
    ("isc", "isc", "isc licen[cs]e", ""),
    ("zlib", "zlib", "zlib(?: libpng)? licen[cs]e", ""),
    ("libpng", "libpng", "libpng licen[cs]e", "2.0"),
    ("ncsa", "illinois", "university of illinois(?: ncsa)? open source licen[cs]e", ""),
    ("ncsa", "ncsa", "ncsa(?: open source)? licen[cs]e", ""),
    ("postgresql", "postgresql", "postgresql licen[cs]e", ""),
    ("openssl", "openssl", "openssl licen[cs]e", ""),
    ("json", "json", "json licen[cs]e", ""),
    ("beerware", "beerware", "beerware licen[cs]e", ""),
    ("wtfpl", "want", "do what the [a-z]+ you want to public licen[cs]e", "1.0 2.0"),
    ("unlicense", "unlicense", "the unlicense", ""),
    ("vim", "vim", "vim licen[cs]e", ""),
    ("tcl", "tcl", "tcl(?: tk)? licen[cs]e", ""),
    ("sleepycat", "sleepycat", "sleepycat(?: public)? licen[cs]e", ""),
    ("qpl", "q", "q public licen[cs]e", "1.0"),
    ("spl", "sun", "sun public licen[cs]e", "1.0"),
    ("sissl", "sun", "sun industry standards source licen[cs]e", "1.1 1.2"),
    ("nasa", "nasa", "nasa open source agreement", "1.3"),
    ("ecl", "educational", "educational community licen[cs]e", "1.0 2.0"),
    ("mulanpsl", "mulan", "mulan permissive software licen[cs]e", "1.0 2.0"),
    ("elastic", "elastic", "elastic licen[cs]e", "2.0"),
    ("polyform", "polyform", "polyform (?:noncommercial|small business|strict|shield|perimeter) licen[cs]e", "1.0"),
    ("commons-clause", "clause", "commons clause(?: licen[cs]e)?", "1.0"),
    ("upl", "universal", "universal permissive licen[cs]e", "1.0"),
    ("blueoak", "oak", "blue oak model licen[cs]e", "1.0"),
    ("odbl", "database", "open (?:data commons open )?database licen[cs]e", "1.0"),
    ("odc-by", "commons", "open data commons attribution licen[cs]e", "1.0"),
    ("pddl", "dedication", "(?:open data commons )?public domain dedication and licen[cs]e", "1.0"),
    ("ogl", "government", "open government licen[cs]e", "1.0 2.0 3.0"),
    ("etalab", "etalab", "etalab(?: open)? licen[cs]e", "1.0 2.0"),
    ("free-art", "art", "free art licen[cs]e", "1.2 1.3"),
    ("oldap", "openldap", "openldap public licen[cs]e", "2.8"),
    ("w3c", "w3c", "w3c software(?: notice and)? licen[cs]e", ""),
    ("unicode", "unicode", "unicode(?: data files and software)? licen[cs]e", "3.0"),
    ("curl", "curl", "curl licen[cs]e", ""),
    ("ijg", "jpeg", "independent jpeg group licen[cs]e", ""),
    ("openrail", "openrail", "(?:creativeml |bigscience )?openrail(?: m)? licen[cs]e", ""),
    ("llama", "llama", "llama (?:2|3|4) community licen[cs]e", ""),
    ("cc0", "cc0", "cc0", "1.0"),
    ("cc0", "zero", "creative commons zero(?: licen[cs]e)?", "1.0"),
)

CREATIVE_COMMONS_VERSIONS = "1.0 2.0 2.5 3.0 4.0"
# Label, short name, long name after "creative commons".
CREATIVE_COMMONS = (
    ("cc-by", "by", "attribution"),
    ("cc-by-sa", "by sa", "attribution (?:sharealike|share alike)"),
    ("cc-by-nc", "by nc", "attribution (?:noncommercial|non commercial)"),
    ("cc-by-nd", "by nd", "attribution (?:noderivatives|noderivs|no derivatives|no derivs)"),
    ("cc-by-nc-sa", "by nc sa", "attribution (?:noncommercial|non commercial) (?:sharealike|share alike)"),
    ("cc-by-nc-nd", "by nc nd", "attribution (?:noncommercial|non commercial) (?:noderivatives|noderivs|no derivatives|no derivs)"),
)

# Short names, with a version only: alone they may mean something else.
SHORT_NAMES = (
    ("gpl", "gpl", "1.0 2.0 3.0"),
    ("lgpl", "lgpl", "2.0 2.1 3.0"),
    ("agpl", "agpl", "1.0 3.0"),
    ("gfdl", "gfdl", "1.1 1.2 1.3"),
    ("apache", "apache", "1.0 1.1 2.0"),
    ("mpl", "mpl", "1.0 1.1 2.0"),
    ("epl", "epl", "1.0 2.0"),
    ("cddl", "cddl", "1.0 1.1"),
    ("eupl", "eupl", "1.1 1.2"),
    ("osl", "osl", "3.0"),
    ("afl", "afl", "3.0"),
    ("bsl", "bsl", "1.0"),
    ("busl", "busl", "1.1"),
    ("sspl", "sspl", "1.0"),
    ("ofl", "ofl", "1.1"),
    ("lppl", "lppl", "1.3"),
    ("wtfpl", "wtfpl", "2.0"),
    ("odbl", "odbl", "1.0"),
)

# Label, keyword, words typical of the licence's own text or of its notice in a file.
SENTENCES = (
    ("gpl", "redistribute", "you (?:can|may) redistribute it and or modify it under the terms of the gnu general public licen[cs]e"),
    ("lgpl", "redistribute", "you (?:can|may) redistribute it and or modify it under the terms of the gnu (?:lesser|library) general public licen[cs]e"),
    ("agpl", "redistribute", "you (?:can|may) redistribute it and or modify it under the terms of the gnu affero general public licen[cs]e"),
    ("gpl-3.0", "copyleft", "the gnu general public licen[cs]e is a free copyleft licen[cs]e"),
    ("agpl-3.0", "copyleft", "the gnu affero general public licen[cs]e is a free copyleft licen[cs]e"),
    ("gpl-2.0", "guarantee", "licen[cs]e is intended to guarantee your freedom to share and change free software"),
    ("gfdl", "invariant", "with no invariant sections"),
    ("mit", "hereby", "permission is hereby granted free of charge to any person obtaining a copy"),
    ("mit", "substantial", "shall be included in all copies or substantial portions of the software"),
    ("bsd", "redistribution", "redistribution and use in source and binary forms with or without modification are permitted"),
    ("bsd", "redistributions", "redistributions of source code must retain the above copyright notice"),
    ("bsd-3-clause", "endorse", "may be used to endorse or promote products derived from this software"),
    ("bsd-4-clause", "advertising", "all advertising materials mentioning features or use of this software must display"),
    ("isc", "purpose", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("apache-2.0", "apache", "licensed under the apache licen[cs]e version 2 0"),
    ("apache-2.0", "compliance", "you may not use this file except in compliance with the licen[cs]e"),
    ("apache-1.1", "apache", "this product includes software developed by the apache software foundation"),
    ("mpl-1.1", "mozilla", "subject to the mozilla public licen[cs]e version 1 1"),
    ("mpl-2.0", "mozilla", "subject to the terms of the mozilla public licen[cs]e v 2 0"),
    ("epl-1.0", "eclipse", "made available under the terms of the eclipse public licen[cs]e v1 0"),
    ("epl-2.0", "eclipse", "made available under the terms of the eclipse public licen[cs]e 2 0"),
    ("cddl", "distribution", "contents of this file are subject to the terms of the common development and distribution licen[cs]e"),
    ("zlib", "misrepresented", "the origin of this software must not be misrepresented"),
    ("zlib", "altered", "altered source versions must be plainly marked as such"),
    ("bsl-1.0", "boost", "distributed under the boost software licen[cs]e version 1 0"),
    ("unlicense", "unencumbered", "this is free and unencumbered software released into the public domain"),
    ("beerware", "beer", "you can buy me a beer in return"),
    ("wtfpl", "want", "you just do what the [a-z]+ you want to"),
    ("json", "evil", "the software shall be used for good not evil"),
    ("ofl-1.1", "font", "this font software is licensed under the sil open font licen[cs]e version 1 1"),
    ("artistic-1.0", "artistic", "semblance of artistic control over the development of the package"),
    ("php", "php", "this product includes php software"),
    ("openssl", "openssl", "this product includes software developed by the openssl project"),
    ("cc-by", "attribution", "licensed under a creative commons attribution(?: (?:1|2|3|4) (?:0|5))? (?:international|unported|generic) licen[cs]e"),
    ("cc0-1.0", "dedicated", "has dedicated the work to the public domain by waiving all of"),
    ("public-domain", "domain", "(?:released|placed|dedicated) (?:in|into|to) the public domain"),
    ("public-domain", "domain", "this (?:work|file|code|text) is in the public domain"),
    ("all-rights-reserved", "rights", "all rights reserved"),
    ("proprietary", "proprietary", "proprietary and confidential"),
    ("proprietary", "prohibited", "unauthori[sz]ed (?:copying|use|distribution)(?: of this file| of this text)? (?:via any medium )?is strictly prohibited"),
    ("busl-1.1", "business", "use of this software is governed by the business source licen[cs]e"),
    ("sspl-1.0", "server", "terms of the server side public licen[cs]e version 1"),
    ("elastic-2.0", "hosted", "you may not provide the software to third parties as a hosted or managed service"),
    ("non-commercial", "purposes", "for (?:noncommercial|non commercial) purposes only"),
    ("free-software", "software", "this is free software see the source for copying conditions"),
)

# Tags besides those that follow from families and versions.
TAGS = (
    "mit", "mit 0", "isc", "zlib", "0bsd", "bsd 2 clause", "bsd 3 clause", "bsd 4 clause", "unlicense", "wtfpl", "ncsa",
    "postgresql", "openssl", "json", "beerware", "x11", "vim", "ruby", "tcl", "sleepycat", "ms pl", "ms rl", "curl", "ijg",
)


def _version(version: str) -> str:
    major, minor = version.split(".")
    return f"(?:version |ver |v )?v?{major}(?: 0)?" if minor == "0" else f"(?:version |ver |v )?v?{major} {minor}"


def _number(version: str) -> str:
    return version.replace(".", " ")


def rules() -> list[Rule]:
    """All rules, in their order."""
    found: list[tuple[int, str, str, str]] = []
    tagged = {(label, v) for label, _, _, versions in FAMILIES for v in versions.split()}
    tagged |= {(label, v) for label, _, _ in CREATIVE_COMMONS for v in CREATIVE_COMMONS_VERSIONS.split()}
    tag = "spdx licen[cs]e identifier "
    for label, version in sorted(tagged):
        name = label.replace("-", " ")
        found.append((TAG, f"{label}-{version}", "spdx", f"{tag}{name} {_number(version)}(?: only| or later)?"))
    for name in TAGS:
        found.append((TAG, name.replace(" ", "-"), "spdx", f"{tag}{name}"))
    for label, keyword, sentence in SENTENCES:
        found.append((SENTENCE, label, keyword, sentence))
    titles = list(FAMILIES)
    for label, short, long in CREATIVE_COMMONS:
        titles.append((label, "cc", f"cc {short}", CREATIVE_COMMONS_VERSIONS))
        titles.append((label, "commons", f"creative commons {long}(?: licen[cs]e)?", CREATIVE_COMMONS_VERSIONS))
    for label, keyword, title, versions in titles:
        for version in versions.split():
            found.append((VERSIONED, f"{label}-{version}", keyword, f"{title} {_version(version)}"))
        found.append((TITLE, label, keyword, title))
    for label, name, versions in SHORT_NAMES:
        for version in versions.split():
            found.append((SHORT, f"{label}-{version}", name, f"{name} {_version(version)}"))
            glued = f"{name}v{version.split('.')[0]}"
            found.append((SHORT, f"{label}-{version}", glued, f"{glued} {version[2:]}" if version[-2:] != ".0" else f"{glued}(?: 0)?"))
    ordered = sorted(enumerate(found), key=lambda r: (r[1][0], r[0]))
    return [Rule(i, *rule) for i, (_, rule) in enumerate(ordered)]
