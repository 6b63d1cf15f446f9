"""Signature rules of the license scan: written by hand as notices and families, the rest follows from templates.

Patterns stand over words in lower case with single spaces between them, and
``licence`` counts as ``license``.  A rule is tried where its keyword stands in the
text at all; keywords stand over words as `spaced` writes them.  Levels are priorities: 0 is a whole
grant or notice, 1 a grant or a name with a version, 2 a name, 3 a hint.
"""

from __future__ import annotations

from typing import NamedTuple


class Rule(NamedTuple):
    """A signature: level (0 first), label, keyword, pattern; `base` marks the phrases that always count."""

    level: int
    label: str
    keyword: str
    pattern: str
    base: bool = False


#: Phrases whose every place counts, and their labels.
BASE = [("gnu general public license", "gpl"), ("apache license", "apache"), ("cc by", "cc-by"), ("mit license", "mit")]

LIC = "licen[cs]e"
GRANT = f"(?:{LIC}d|released|distributed|available|published|provided|offered|covered|governed|redistributed|issued|shared) (?:only )?(?:under|by) (?:the |a |an )?(?:terms of (?:the )?|conditions of (?:the )?|terms and conditions of (?:the )?)?"

#: Label, keyword, name, versions (words apart by one space).
FAMILIES: list[tuple[str, str, str, list[str]]] = [
    ("gpl", "gnu", f"gnu (?:general public {LIC}|gpl)", ["1", "2", "3"]),
    ("gpl", "gpl", "gpl", ["1", "2", "3"]),
    ("lgpl", "gnu", f"gnu (?:(?:lesser|library) general public {LIC}|lgpl)", ["2", "2 1", "3"]),
    ("lgpl", "lgpl", "lgpl", ["2", "2 1", "3"]),
    ("agpl", "gnu", f"gnu (?:affero general public {LIC}|agpl)", ["1", "3"]),
    ("agpl", "agpl", "agpl", ["1", "3"]),
    ("gfdl", "gnu", f"gnu (?:free documentation {LIC}|fdl)", ["1 1", "1 2", "1 3"]),
    ("apache", "apache", f"apache(?: software)? {LIC}", ["1", "1 1", "2"]),
    ("mit", "licen", f"(?:mit|expat|x11) {LIC}", []),
    ("bsd", "bsd", f"(?:new |modified |simplified |revised |original )?bsd(?: style)? {LIC}", []),
    ("bsd-2-clause", "bsd", f"(?:bsd 2 clause|2 clause bsd|two clause bsd|freebsd)(?: {LIC})?", []),
    ("bsd-3-clause", "bsd", f"(?:bsd 3 clause|3 clause bsd|three clause bsd)(?: {LIC})?", []),
    ("bsd-4-clause", "bsd", f"(?:bsd 4 clause|4 clause bsd|four clause bsd)(?: {LIC})?", []),
    ("0bsd", "bsd", f"(?:zero clause bsd|bsd zero clause|0bsd)(?: {LIC})?", []),
    ("isc", " isc ", f"isc {LIC}", []),
    ("mpl", "mozilla", f"mozilla public {LIC}", ["1", "1 1", "2"]),
    ("mpl", "mpl", "mpl", ["1", "1 1", "2"]),
    ("epl", "eclipse", f"eclipse public {LIC}", ["1", "2"]),
    ("edl", "eclipse", f"eclipse distribution {LIC}", ["1"]),
    ("cddl", "common  development", f"common development and distribution {LIC}", ["1", "1 1"]),
    ("cddl", "cddl", "cddl", ["1", "1 1"]),
    ("cpl", "common  public", f"common public {LIC}", ["1"]),
    ("eupl", "european  union", f"european union public {LIC}", ["1 1", "1 2"]),
    ("eupl", "eupl", "eupl", ["1 1", "1 2"]),
    ("artistic", "artistic", f"artistic {LIC}", ["1", "2"]),
    ("perl", "perl", f"same terms as perl(?: itself)?", []),
    ("boost", "boost", f"boost software {LIC}", ["1"]),
    ("zlib", "zlib", f"zlib(?: libpng)? {LIC}", []),
    ("libpng", "libpng", f"libpng {LIC}", ["2"]),
    ("unlicense", "unlicense", "(?:the )?unlicense", []),
    ("wtfpl", "wtfpl", "wtfpl", ["2"]),
    ("python", "python", f"(?:python software foundation|python) {LIC}", ["2"]),
    ("php", "php", f"php {LIC}", ["3", "3 01"]),
    ("ruby", "ruby", f"ruby {LIC}", []),
    ("postgresql", "postgresql", f"postgresql {LIC}", []),
    ("openssl", "openssl", f"openssl {LIC}", []),
    ("ofl", "open  font", f"(?:sil )?open font {LIC}", ["1", "1 1"]),
    ("ncsa", "ncsa", f"(?:university of illinois )?ncsa(?: open source)? {LIC}", []),
    ("upl", "universal  permissive", f"universal permissive {LIC}", ["1"]),
    ("afl", "academic  free", f"academic free {LIC}", ["2 1", "3"]),
    ("osl", "open  software", f"open software {LIC}", ["2 1", "3"]),
    ("ms-pl", "microsoft", f"microsoft public {LIC}", []),
    ("ms-rl", "microsoft", f"microsoft reciprocal {LIC}", []),
    ("apsl", "apple  public", f"apple public source {LIC}", ["1 2", "2"]),
    ("cecill", "cecill", "cecill(?: b| c)?", ["1", "2", "2 1"]),
    ("bsl", "business  source", f"business source {LIC}", ["1 1"]),
    ("sspl", "server  side", f"server side public {LIC}", ["1"]),
    ("elastic", "elastic  licen", f"elastic {LIC}", ["2"]),
    ("odbl", "open  d", f"(?:odc )?open (?:data commons open )?database {LIC}", ["1"]),
    ("odc-by", "attribution", f"open data commons attribution {LIC}", ["1"]),
    ("pddl", "public  domain", f"public domain dedication and {LIC}", ["1"]),
    ("ogl", "open  government", f"open government {LIC}", ["1", "2", "3"]),
    ("mulan", "mulan", f"mulan (?:psl|permissive software {LIC})", ["1", "2"]),
    ("llama", "llama", f"llama(?: [23])? community {LIC}", []),
    ("openrail", "openrail", f"(?:creativeml |bigscience )?openrail(?: m| s)?(?: {LIC})?", []),
    ("cc0", "cc0", f"cc0(?: {LIC})?", ["1"]),
    ("cc0", "creative  commons", "creative commons (?:zero|cc0)(?: public domain dedication)?", ["1"]),
    ("cc-pdm", "public  domain", "(?:creative commons )?public domain mark", ["1"]),
    ("cc-by", "cc  by", f"cc by(?: {LIC})?", ["1", "2", "2 5", "3", "4"]),
    ("cc-by-sa", "cc  by", f"cc by sa(?: {LIC})?", ["1", "2", "2 5", "3", "4"]),
    ("cc-by-nc", "cc  by", f"cc by nc(?: {LIC})?", ["1", "2", "2 5", "3", "4"]),
    ("cc-by-nd", "cc  by", f"cc by nd(?: {LIC})?", ["1", "2", "2 5", "3", "4"]),
    ("cc-by-nc-sa", "cc  by", f"cc by nc sa(?: {LIC})?", ["1", "2", "2 5", "3", "4"]),
    ("cc-by-nc-nd", "cc  by", f"cc by nc nd(?: {LIC})?", ["1", "2", "2 5", "3", "4"]),
    ("cc-by", "creative  commons", f"creative commons attribution(?: international| unported)?(?: {LIC})?", ["2", "2 5", "3", "4"]),
    ("cc-by-sa", "creative  commons", f"creative commons attribution share(?: )?alike(?: international| unported)?(?: {LIC})?", ["2", "2 5", "3", "4"]),
    ("cc-by-nc", "creative  commons", f"creative commons attribution non(?: )?commercial(?: international| unported)?(?: {LIC})?", ["2", "2 5", "3", "4"]),
    ("cc-by-nd", "creative  commons", f"creative commons attribution no(?: )?deriv(?:ative)?s?(?: international| unported)?(?: {LIC})?", ["2", "2 5", "3", "4"]),
    ("cc-by-nc-sa", "creative  commons", f"creative commons attribution non(?: )?commercial share(?: )?alike(?: international| unported)?(?: {LIC})?", ["2", "2 5", "3", "4"]),
    ("cc-by-nc-nd", "creative  commons", f"creative commons attribution non(?: )?commercial no(?: )?deriv(?:ative)?s?(?: international| unported)?(?: {LIC})?", ["2", "2 5", "3", "4"]),
]

#: Whole sentences of notices, addresses and remarks: level, label, keyword, pattern.
NOTICES: list[tuple[int, str, str, str]] = [
    (0, "mit", "permission", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    (0, "isc", "permission", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice"),
    (0, "0bsd", "permission", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted the software is provided"),
    (1, "isc", "permission", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    (0, "bsd", "redistribution", "redistribution and use in source and binary forms with or without modification are permitted"),
    (1, "bsd-3-clause", "neither", "neither the name of (?:the )?(?:copyright holder|author|university|[a-z]+)(?: nor the names of (?:its|his|their) contributors)? may be used to endorse or promote products"),
    (1, "bsd-4-clause", "advertising", "all advertising materials mentioning features or use of this software must display"),
    (0, "gpl", "free  software", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license"),
    (0, "lgpl", "free  software", "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license"),
    (0, "agpl", "free  software", "this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license"),
    (1, "gpl", "gnu", "you should have received a copy of the gnu general public license along with this program"),
    (1, "lgpl", "gnu", "you should have received a copy of the gnu lesser general public license along with this (?:library|program)"),
    (1, "agpl", "gnu", "you should have received a copy of the gnu affero general public license along with this program"),
    (1, "gpl", "any  later", "(?:either version )?[123] of the license or at your option any later version"),
    (1, "gfdl", "gnu", "permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation license"),
    (0, "apache-2", "apache", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license"),
    (1, "apache", "apache", "licensed to the apache software foundation asf under one or more contributor license agreements"),
    (1, "apache-2", "apache", "(?:www )?apache org licenses license 2 0"),
    (0, "mpl-2", "mozilla", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    (1, "mpl-2", "mpl", "if a copy of the mpl was not distributed with this file you can obtain one at"),
    (0, "epl-2", "eclipse", "this program and the accompanying materials are made available under the terms of the eclipse public license 2 0"),
    (0, "epl-1", "eclipse", "this program and the accompanying materials are made available under the terms of the eclipse public license v1 0"),
    (0, "cddl", "common  development", "the contents of this file are subject to the terms of the common development and distribution license"),
    (0, "boost-1", "permission", "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation"),
    (1, "boost-1", "boost", "distributed under the boost software license version 1 0"),
    (0, "zlib", "implied", "this software is provided as is without any express or implied warranty in no event will the authors be held liable"),
    (1, "zlib", "freely", "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely"),
    (0, "unlicense", "unencumbered", "this is free and unencumbered software released into the public domain"),
    (0, "wtfpl", "fuck", "do what the fuck you want to public license"),
    (0, "ofl", "font  software", "this font software is licensed under the sil open font license"),
    (0, "cc0", "copyright", "to the extent possible under law (?:the author has|[a-z]+ has) waived all copyright and related or neighboring rights"),
    (1, "cc0", "creativecommons", "creativecommons org publicdomain zero 1 0"),
    (1, "cc-pdm", "creativecommons", "creativecommons org publicdomain mark 1 0"),
    (1, "cc-by", "creativecommons", "creativecommons org licenses by [1234] [05]"),
    (1, "cc-by-sa", "creativecommons", "creativecommons org licenses by sa [1234] [05]"),
    (1, "cc-by-nc", "creativecommons", "creativecommons org licenses by nc [1234] [05]"),
    (1, "cc-by-nd", "creativecommons", "creativecommons org licenses by nd [1234] [05]"),
    (1, "cc-by-nc-sa", "creativecommons", "creativecommons org licenses by nc sa [1234] [05]"),
    (1, "cc-by-nc-nd", "creativecommons", "creativecommons org licenses by nc nd [1234] [05]"),
    (1, "gpl", "gnu", "(?:www )?gnu org (?:licenses|copyleft) gpl(?: [123] 0)?(?: (?:html|txt))?"),
    (1, "lgpl", "gnu", "(?:www )?gnu org (?:licenses|copyleft) (?:old licenses )?lgpl(?: [23] [01])?(?: (?:html|txt))?"),
    (1, "agpl", "gnu", "(?:www )?gnu org licenses agpl(?: 3 0)?(?: (?:html|txt))?"),
    (1, "mit", "opensource", "(?:www )?opensource org licenses mit(?: license)?(?: php)?"),
    (1, "bsd", "opensource", "(?:www )?opensource org licenses bsd(?: license| [23] clause)?(?: php)?"),
    (1, "isc", "opensource", "(?:www )?opensource org licenses isc(?: license)?"),
    (1, "apache-2", "opensource", "(?:www )?opensource org licenses apache 2 0"),
    (1, "mpl-2", "mozilla", "(?:www )?mozilla org mpl 2 0"),
    (1, "unlicense", "unlicense", "unlicense org"),
    (1, "php-3.01", "php", "(?:www )?php net license 3 01 txt"),
    (1, "python", "python", "psf license agreement for python"),
    (2, "public-domain", "public  domain", "(?:released|placed|dedicated|put) (?:in|into|to) the public domain"),
    (2, "public-domain", "public  domain", "(?:is|are|in) (?:in )?the public domain"),
    (3, "public-domain", "public  domain", "public domain"),
    (2, "proprietary", "proprietary", "proprietary and confidential"),
    (2, "proprietary", "permission", "without (?:the )?(?:prior )?(?:express )?(?:written )?permission of the (?:copyright (?:holder|owner)|author|publisher)s?"),
    (2, "proprietary", "may  not  be", "may not be (?:reproduced|copied)(?: or)? (?:distributed|transmitted|redistributed)"),
    (2, "proprietary", "evaluation", f"evaluation (?:{LIC}|purposes only|use only)"),
    (2, "proprietary", "end  user", f"end user {LIC}(?: agreement)?"),
    (2, "non-commercial", "commercial  ", "(?:for )?non(?: )?commercial (?:use|purposes|research)(?: only)?"),
    (2, "research-only", "research", "(?:for )?(?:academic |scientific )?research (?:use|purposes) only"),
    (2, "dual-license", "dual  licen", f"dual {LIC}d?"),
    (3, "all-rights-reserved", "rights  reserved", "(?:all|some) rights reserved"),
    (3, "copyleft", "copyleft", "copyleft"),
    (3, "open-source", "open  source", "open source (?:software|project|initiative)"),
    (3, "creative-commons", "creative  commons", "creative commons"),
    (3, "free-software", "free  software", "free software foundation"),
    (3, "royalty-free", "royalty", "royalty free"),
]

#: Words of SPDX identifiers (hyphens and dots part words) that stand for a label of their own.
SPDX = (
    "0bsd|afl 3 0|agpl 3 0|apache 1 1|apache 2 0|apsl 2 0|artistic 1 0|artistic 2 0|bsd 2 clause|bsd 3 clause|bsd 4 clause|bsl 1 0|busl 1 1|cc by 3 0|cc by 4 0|cc by nc 4 0|cc by nc nd 4 0|cc by nc sa 4 0|cc by nd 4 0|cc by sa 3 0|cc by sa 4 0|cc0 1 0|cddl 1 0|cddl 1 1|cecill 2 1|cpl 1 0"
    "|ecl 2 0|efl 2 0|epl 1 0|epl 2 0|eupl 1 1|eupl 1 2|gfdl 1 2|gfdl 1 3|gpl 1 0|gpl 2 0|gpl 3 0|isc|lgpl 2 0|lgpl 2 1|lgpl 3 0|lppl 1 3c|mit|mit 0|mpl 1 1|mpl 2 0|ms pl|ms rl|mulanpsl 2 0|ncsa|odbl 1 0|ofl 1 1|openssl|osl 3 0|php 3 01|postgresql|python 2 0|qpl 1 0|ruby|sspl 1 0|unlicense|upl 1 0|vim|w3c|wtfpl|x11|zlib|zpl 2 1"
).split("|")


def rules() -> list[Rule]:
    """All rules in their order: earlier ones win where level and place are equal."""
    out = [Rule(level, label, keyword, pattern) for level, label, keyword, pattern in NOTICES]
    out += [Rule(0, words.replace(" ", "-"), "spdx", f"spdx {LIC} identifier {words}(?: only| or later)?") for words in SPDX]
    for label, keyword, name, versions in FAMILIES:
        for version in versions:
            dotted = version.replace(" ", ".")
            said = f"(?: version| ver| v)? v?{version}" + ("(?: 0)?" if " " not in version else "") + "(?: only| or later| or any later version)?"
            out.append(Rule(0, f"{label}-{dotted}", keyword, f"{GRANT}{name}{said}"))
            out.append(Rule(1, f"{label}-{dotted}", keyword, f"{name}{said}"))
        out.append(Rule(1, label, keyword, f"{GRANT}{name}"))
        out.append(Rule(2, label, keyword, name))
    return out + [Rule(2, label, spaced(phrase), phrase, True) for phrase, label in BASE]


def spaced(pattern: str) -> str:
    """A pattern over words that each have a space before and behind: ``a b`` becomes `` a  b ``."""
    return f" {pattern.replace(' ', '  ')} "
