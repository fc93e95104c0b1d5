"""The rules of the license scan: expressions over lower-case words between single spaces.

A rule is (label, tier, keyword, expression). The keyword is a word that stands in every text in which
the rule can match; the rule is tried where its keyword is a word of the text. A form
without a common word is a rule of its own. The order of the rules settles ties.
"""

from __future__ import annotations

#: Tiers of priority, and the confidence of a rule in each.
SPDX, TEXT, GRANT, VERSIONED, NAMED, SHORT = 6, 5, 4, 3, 2, 1
CONFIDENCE = {SPDX: 1.0, TEXT: 0.98, GRANT: 0.95, VERSIONED: 0.9, NAMED: 0.75, SHORT: 0.5}

Rule = tuple[str, int, str, str]

#: Parts that expressions share: license in both spellings, an SPDX tag, the words that grant, and words of licensing, beside which
#: names count that other things have too.
L = "licen[cs]e"
TAG = "spdx licen[cs]e identifier"
G = "(?:licen[cs]ed|released|distributed|available|published|provided|covered|offered) (?:under|by)(?: the)?(?: terms(?: and conditions)? of)?(?: the)?(?: gnu)?"

B = "(?:(?:sub)?licen[cs](?:e[ds]?|ing)|copyright(?:ed)?|under|terms)"

PERMISSIVE: list[Rule] = [
    ("apache-1.0", SPDX, "spdx", f"{TAG} apache 1 0"),
    ("apache-1.1", SPDX, "spdx", f"{TAG} apache 1 1"),
    ("apache-2.0", SPDX, "spdx", f"{TAG} apache 2 0(?: with llvm exception)?"),
    ("apache", TEXT, "compliance", "you may not use this file except in compliance with the license"),
    ("apache-2.0", TEXT, "apache", f"apache {L} version 2 0 january 2004(?: http www apache org licenses)?"),
    ("apache-1.1", TEXT, "apache", "this product includes software developed by the apache software foundation"),
    ("apache-2.0", TEXT, "contributor", "each contributor hereby grants to you a perpetual worldwide non exclusive no charge royalty free irrevocable copyright license"),
    ("apache-1.0", GRANT, "apache", f"{G} apache(?: software)?(?: {L})?(?: version)? 1 0"),
    ("apache-1.1", GRANT, "apache", f"{G} apache(?: software)?(?: {L})?(?: version)? 1 1"),
    ("apache-2.0", GRANT, "apache", f"{G} apache(?: software)?(?: {L})?(?: version| v)? 2 0"),
    ("apache", GRANT, "apache", f"{G} apache(?: software)?(?: {L})?"),
    ("apache-2.0", GRANT, "asl", f"{G} asl 2 0"),
    ("apache-1.0", VERSIONED, "apache", f"apache(?: software)?(?: {L})?(?: version)? 1 0"),
    ("apache-1.1", VERSIONED, "apache", f"apache(?: software)?(?: {L})?(?: version)? 1 1"),
    ("apache-2.0", VERSIONED, "apache", f"apache(?: software)?(?: {L})?(?: version| v)? 2 0"),
    ("apache-2.0", VERSIONED, "apache", "(?:www )?apache org licenses license 2 0(?: txt| html)?"),
    ("apache-2.0", VERSIONED, "apache2", f"apache2(?: {L})?"),
    ("apache-2.0", VERSIONED, "asl2", "asl2"),
    ("apache", NAMED, "apache", f"apache(?: software)? {L}"),
    ("apache", NAMED, "opensource", "opensource org licenses apache 2 0"),
    ("apache", SHORT, "apache", f"{B} (?:[^ ]+ ){{0,2}}apache"),
    ("apache", SHORT, "apache", f"apache (?:[^ ]+ ){{0,2}}{B}"),
    ("mit", SPDX, "spdx", f"{TAG} mit"),
    ("mit-0", SPDX, "spdx", f"{TAG} mit 0"),
    ("mit", TEXT, "permission", "permission is hereby granted free of charge to any person obtaining a copy"),
    ("mit", TEXT, "substantial", "the above copyright notice and this permission notice shall be included in all copies or substantial portions"),
    ("mit", TEXT, "merge", "to use copy modify merge publish distribute sublicense and or sell copies of the software"),
    ("mit", TEXT, "tort", "whether in an action of contract tort or otherwise arising from out of or in connection with the software"),
    ("mit", GRANT, "mit", f"{G} mit(?: x11)?(?: open source)?(?: {L})?"),
    ("mit", GRANT, "expat", f"{G} expat(?: {L})?"),
    ("mit-0", VERSIONED, "mit", f"mit no attribution(?: {L})?"),
    ("mit", NAMED, "mit", f"mit(?: x11| expat)?(?: style| open source)? {L}"),
    ("mit", NAMED, "expat", f"expat {L}"),
    ("mit", NAMED, "opensource", "opensource org licenses mit"),
    ("mit", NAMED, "x11", f"x11(?: style)? {L}"),
    ("mit", NAMED, "mit", f"{L} mit"),
    ("bsd-0-clause", SPDX, "spdx", f"{TAG} 0bsd"),
    ("bsd-1-clause", SPDX, "spdx", f"{TAG} bsd 1 clause"),
    ("bsd-2-clause", SPDX, "spdx", f"{TAG} bsd 2 clause(?: patent| freebsd)?"),
    ("bsd-3-clause", SPDX, "spdx", f"{TAG} bsd 3 clause(?: clear| lbnl)?"),
    ("bsd-4-clause", SPDX, "spdx", f"{TAG} bsd 4 clause(?: uc)?"),
    ("bsd", SPDX, "spdx", f"{TAG} bsd"),
    ("bsd", TEXT, "redistribution", "redistribution and use in source and binary forms with or without modification are permitted"),
    ("bsd", TEXT, "endorse", "may be used to endorse or promote products derived from this software"),
    ("bsd", TEXT, "redistributions", "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer"),
    ("bsd", TEXT, "redistributions", "redistributions in binary form must reproduce the above copyright notice"),
    ("bsd-4-clause", TEXT, "advertising", "all advertising materials mentioning features or use of this software must display the following acknowledge?ment"),
    ("bsd", TEXT, "negligence", "whether in contract strict liability or tort including negligence or otherwise arising in any way out of the use of this software"),
    ("bsd-2-clause", GRANT, "bsd", f"{G} (?:(?:simplified|freebsd) )?bsd(?: {L})? 2 clause(?: {L})?"),
    ("bsd-3-clause", GRANT, "bsd", f"{G} (?:(?:new|modified|revised) )?bsd(?: {L})? 3 clause(?: {L})?"),
    ("bsd-4-clause", GRANT, "bsd", f"{G} (?:original )?bsd(?: {L})? 4 clause(?: {L})?"),
    ("bsd-2-clause", GRANT, "simplified", f"{G} simplified bsd(?: {L})?"),
    ("bsd-3-clause", GRANT, "bsd", f"{G} (?:new|modified|revised) bsd(?: {L})?"),
    ("bsd", GRANT, "bsd", f"{G} bsd(?: style)?(?: {L})?"),
    ("bsd-2-clause", VERSIONED, "bsd", f"(?:(?:simplified|freebsd) )?bsd(?: {L})? 2 clause"),
    ("bsd-3-clause", VERSIONED, "bsd", f"(?:(?:new|modified|revised) )?bsd(?: {L})? 3 clause"),
    ("bsd-4-clause", VERSIONED, "bsd", f"(?:original )?bsd(?: {L})? 4 clause"),
    ("bsd-2-clause", VERSIONED, "clause", f"(?:2|two) clause bsd(?: {L})?"),
    ("bsd-3-clause", VERSIONED, "clause", f"(?:3|three) clause bsd(?: {L})?"),
    ("bsd-4-clause", VERSIONED, "clause", f"(?:4|four) clause bsd(?: {L})?"),
    ("bsd-0-clause", VERSIONED, "0bsd", f"0bsd(?: {L})?"),
    ("bsd-0-clause", VERSIONED, "clause", "zero clause bsd"),
    ("bsd-2-clause", NAMED, "simplified", f"simplified bsd(?: {L})?"),
    ("bsd-2-clause", NAMED, "freebsd", f"freebsd {L}"),
    ("bsd-3-clause", NAMED, "bsd", f"(?:new|modified|revised) bsd(?: {L})?"),
    ("bsd-4-clause", NAMED, "bsd", f"original bsd {L}"),
    ("bsd", NAMED, "bsd", f"bsd(?: style)? {L}"),
    ("bsd", NAMED, "berkeley", f"berkeley software distribution(?: {L})?"),
    ("bsd-3-clause", NAMED, "opensource", "opensource org licenses bsd(?: 3 clause| license)"),
    ("bsd", SHORT, "bsd", f"{B} (?:[^ ]+ ){{0,2}}bsd"),
    ("bsd", SHORT, "bsd", f"bsd (?:[^ ]+ ){{0,2}}{B}"),
    ("isc", SPDX, "spdx", f"{TAG} isc"),
    ("isc", TEXT, "permission", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("isc", GRANT, "isc", f"{G} isc(?: {L})?"),
    ("isc", NAMED, "isc", f"isc(?: style)? {L}"),
    ("isc", NAMED, "consortium", f"internet (?:software|systems) consortium {L}"),
    ("zlib", SPDX, "spdx", f"{TAG} zlib(?: acknowledgement)?"),
    ("zlib", TEXT, "altered", "altered source versions must be plainly marked as such"),
    ("zlib", TEXT, "misrepresented", "the origin of this software must not be misrepresented"),
    ("zlib", GRANT, "zlib", f"{G} zlib(?: libpng)?(?: {L})?"),
    ("zlib", NAMED, "zlib", f"zlib(?: libpng)? {L}"),
    ("zlib", SHORT, "zlib", f"{B} (?:[^ ]+ ){{0,2}}zlib"),
    ("zlib", SHORT, "zlib", f"zlib (?:[^ ]+ ){{0,2}}{B}"),
    ("libpng", NAMED, "libpng", f"libpng {L}"),
    ("boost-1.0", SPDX, "spdx", f"{TAG} bsl 1 0"),
    ("boost-1.0", TEXT, "boost", f"boost software {L} version 1 0 august 17th 2003"),
    ("boost-1.0", GRANT, "boost", f"{G} boost(?: software)?(?: {L})?(?: version)? 1 0"),
    ("boost", GRANT, "boost", f"{G} boost(?: software)?(?: {L})?"),
    ("boost-1.0", VERSIONED, "boost", f"boost(?: software)?(?: {L})?(?: version)? 1 0"),
    ("boost", NAMED, "boost", f"boost(?: software)? {L}"),
    ("unlicense", SPDX, "spdx", f"{TAG} unlicense"),
    ("unlicense", TEXT, "unencumbered", "this is free and unencumbered software released into the public domain"),
    ("unlicense", GRANT, "unlicense", f"{G} unlicense"),
    ("unlicense", NAMED, "unlicense", "(?:the )?unlicense org"),
    ("unlicense", SHORT, "unlicense", "unlicense"),
    ("wtfpl-2", SPDX, "spdx", f"{TAG} wtfpl"),
    ("wtfpl", TEXT, "fuck", "you just do what the fuck you want to"),
    ("wtfpl-2", VERSIONED, "fuck", f"do what the fuck you want to public(?: {L})?(?: version)? 2(?: 0)?"),
    ("wtfpl-2", VERSIONED, "wtfpl", "wtfpl(?: version)? v?2(?: 0)?"),
    ("wtfpl", NAMED, "fuck", f"do what the fuck you want to public(?: {L})?"),
    ("wtfpl", SHORT, "wtfpl", "wtfpl"),
    ("blueoak-1.0", SPDX, "spdx", f"{TAG} blueoak 1 0 0"),
    ("blueoak", NAMED, "oak", f"blue oak model {L}(?: 1 0 0)?"),
    ("upl-1.0", SPDX, "spdx", f"{TAG} upl 1 0"),
    ("upl-1.0", VERSIONED, "universal", f"universal permissive(?: {L})?(?: version| v)? 1 0"),
    ("upl", NAMED, "universal", f"universal permissive {L}"),
    ("ncsa", SPDX, "spdx", f"{TAG} ncsa"),
    ("ncsa", GRANT, "ncsa", f"{G} (?:university of illinois )?ncsa(?: open source)?(?: {L})?"),
    ("ncsa", NAMED, "ncsa", f"(?:university of illinois )?ncsa(?: open source)? {L}"),
    ("postgresql", SPDX, "spdx", f"{TAG} postgresql"),
    ("postgresql", GRANT, "postgresql", f"{G} postgresql {L}"),
    ("postgresql", NAMED, "postgresql", f"postgresql {L}"),
    ("openssl", SPDX, "spdx", f"{TAG} openssl"),
    ("openssl", TEXT, "openssl", "this product includes software developed by the openssl project"),
    ("openssl", NAMED, "openssl", f"openssl(?: ssleay)? {L}"),
    ("python-2.0", SPDX, "spdx", f"{TAG} (?:psf|python) 2 0"),
    ("python", GRANT, "python", f"{G} python(?: software foundation)? {L}"),
    ("python-2.0", VERSIONED, "python", f"python(?: software foundation)? {L}(?: version)? 2(?: 0)?"),
    ("python", NAMED, "python", f"python(?: software foundation)? {L}"),
    ("php-3.01", SPDX, "spdx", f"{TAG} php 3 01"),
    ("php-3.01", VERSIONED, "php", f"php {L}(?: version)? 3 01"),
    ("php", NAMED, "php", f"php {L}"),
    ("ruby", NAMED, "ruby", f"ruby {L}"),
    ("vim", SPDX, "spdx", f"{TAG} vim"),
    ("vim", NAMED, "vim", f"vim {L}"),
    ("w3c", SPDX, "spdx", f"{TAG} w3c(?: 20150513)?"),
    ("w3c", NAMED, "w3c", f"w3c software(?: notice)?(?: and)?(?: document)?(?: {L})?"),
    ("curl", NAMED, "curl", f"curl {L}"),
    ("icu", NAMED, "icu", f"icu {L}"),
    ("unicode", NAMED, "unicode", f"unicode {L}(?: v3| agreement)?"),
    ("fair", NAMED, "fair", f"fair {L}"),
    ("afl-3.0", SPDX, "spdx", f"{TAG} afl 3 0"),
    ("afl-3.0", VERSIONED, "academic", f"academic free {L}(?: version| v)? 3 0"),
    ("afl", NAMED, "academic", f"academic free {L}"),
    ("ecl-2.0", VERSIONED, "educational", f"educational community {L}(?: version)? 2 0"),
    ("ecl", NAMED, "educational", f"educational community {L}"),
    ("ms-pl", SPDX, "spdx", f"{TAG} ms pl"),
    ("ms-pl", NAMED, "microsoft", f"microsoft public {L}"),
    ("ms-rl", SPDX, "spdx", f"{TAG} ms rl"),
    ("ms-rl", NAMED, "microsoft", f"microsoft reciprocal {L}"),
    ("mulan-2.0", SPDX, "spdx", f"{TAG} mulanpsl 2 0"),
    ("mulan", NAMED, "mulan", f"mulan permissive software {L}(?: v2| version 2)?"),
]

COPYLEFT: list[Rule] = [
    ("gpl-1.0", SPDX, "spdx", f"{TAG} gpl 1 0(?: only| or later)?"),
    ("gpl-2.0", SPDX, "spdx", f"{TAG} gpl 2 0(?: only| or later)?(?: with classpath exception 2 0)?"),
    ("gpl-3.0", SPDX, "spdx", f"{TAG} gpl 3 0(?: only| or later)?"),
    ("gpl", SPDX, "spdx", f"{TAG} gpl"),
    ("gpl", TEXT, "redistribute", "this program is free software you can redistribute it and or modify it"),
    ("gpl", TEXT, "copyleft", "the gnu general public license is a free copyleft license"),
    ("gpl-2.0", TEXT, "gnu", "gnu general public license version 2 june 1991"),
    ("gpl-3.0", TEXT, "gnu", "gnu general public license version 3 29 june 2007"),
    ("gpl", TEXT, "received", "you should have received a copy of the gnu general public license along with this program"),
    ("gpl", TEXT, "merchantability", "without even the implied warranty of merchantability or fitness for a particular purpose see the gnu general public license"),
    ("gpl-1.0", GRANT, "general", f"{G} general public(?: {L})?(?: version)? 1(?: 0)?(?: or later)?"),
    ("gpl-2.0", GRANT, "general", f"{G} general public(?: {L})?(?: version)? 2(?: 0)?(?: or later| or any later version)?"),
    ("gpl-3.0", GRANT, "general", f"{G} general public(?: {L})?(?: version)? 3(?: 0)?(?: or later| or any later version)?"),
    ("gpl", GRANT, "general", f"{G} general public(?: {L})?"),
    ("gpl-1.0", GRANT, "gpl", f"{G} gpl(?: {L})?(?: version)? v?1(?: 0)?(?: or later)?"),
    ("gpl-2.0", GRANT, "gpl", f"{G} gpl(?: {L})?(?: version)? v?2(?: 0)?(?: or later)?"),
    ("gpl-3.0", GRANT, "gpl", f"{G} gpl(?: {L})?(?: version)? v?3(?: 0)?(?: or later)?"),
    ("gpl", GRANT, "gpl", f"{G} gpl(?: {L})?"),
    ("gpl-1.0", VERSIONED, "general", f"(?:gnu )?general public(?: {L})?(?: version| v)? 1(?: 0)?"),
    ("gpl-2.0", VERSIONED, "general", f"(?:gnu )?general public(?: {L})?(?: version| v)? 2(?: 0)?"),
    ("gpl-3.0", VERSIONED, "general", f"(?:gnu )?general public(?: {L})?(?: version| v)? 3(?: 0)?"),
    ("gpl-1.0", VERSIONED, "gpl", f"(?:gnu )?gpl(?: {L})?(?: version)? v?1(?: 0)?"),
    ("gpl-2.0", VERSIONED, "gpl", f"(?:gnu )?gpl(?: {L})?(?: version)? v?2(?: 0)?"),
    ("gpl-3.0", VERSIONED, "gpl", f"(?:gnu )?gpl(?: {L})?(?: version)? v?3(?: 0)?"),
    ("gpl-2.0", VERSIONED, "gplv2", f"(?:gnu )?gplv2(?: {L})?"),
    ("gpl-3.0", VERSIONED, "gplv3", f"(?:gnu )?gplv3(?: {L})?"),
    ("gpl-2.0", VERSIONED, "gpl2", "gpl2"),
    ("gpl-3.0", VERSIONED, "gpl3", "gpl3"),
    ("gpl-3.0", VERSIONED, "gnu", "gnu org licenses gpl 3 0(?: en)?(?: html| txt)?"),
    ("gpl-2.0", VERSIONED, "gnu", "gnu org licenses (?:old licenses )?gpl 2 0(?: en)?(?: html| txt)?"),
    ("gpl", NAMED, "general", f"(?:gnu )?general public {L}"),
    ("gpl", NAMED, "gpl", f"(?:gnu )?gpl {L}"),
    ("gpl", NAMED, "gnu", "gnu org licenses gpl(?: html| txt)?"),
    ("gpl", SHORT, "gpl", "(?:gnu )?gpl"),
    ("lgpl-2.0", SPDX, "spdx", f"{TAG} lgpl 2 0(?: only| or later)?"),
    ("lgpl-2.1", SPDX, "spdx", f"{TAG} lgpl 2 1(?: only| or later)?"),
    ("lgpl-3.0", SPDX, "spdx", f"{TAG} lgpl 3 0(?: only| or later)?"),
    ("lgpl", SPDX, "spdx", f"{TAG} lgpl"),
    ("lgpl", TEXT, "redistribute", "this library is free software you can redistribute it and or modify it"),
    ("lgpl-2.1", TEXT, "lesser", "gnu lesser general public license version 2 1 february 1999"),
    ("lgpl-3.0", TEXT, "lesser", "gnu lesser general public license version 3 29 june 2007"),
    ("lgpl-2.0", GRANT, "lesser", f"{G} lesser general public(?: {L})?(?: version)? 2(?: 0)?(?: or later)?"),
    ("lgpl-2.1", GRANT, "lesser", f"{G} lesser general public(?: {L})?(?: version)? 2 1(?: or later)?"),
    ("lgpl-3.0", GRANT, "lesser", f"{G} lesser general public(?: {L})?(?: version)? 3(?: 0)?(?: or later)?"),
    ("lgpl", GRANT, "lesser", f"{G} lesser general public(?: {L})?"),
    ("lgpl-2.0", GRANT, "library", f"{G} library general public(?: {L})?(?: version)? 2(?: 0)?(?: or later)?"),
    ("lgpl", GRANT, "library", f"{G} library general public(?: {L})?"),
    ("lgpl-2.0", GRANT, "lgpl", f"{G} lgpl(?: version)? v?2(?: 0)?(?: or later)?"),
    ("lgpl-2.1", GRANT, "lgpl", f"{G} lgpl(?: version)? v?2 1(?: or later)?"),
    ("lgpl-3.0", GRANT, "lgpl", f"{G} lgpl(?: version)? v?3(?: 0)?(?: or later)?"),
    ("lgpl", GRANT, "lgpl", f"{G} lgpl"),
    ("lgpl-2.1", VERSIONED, "lesser", f"(?:gnu )?lesser general public(?: {L})?(?: version| v)? 2 1"),
    ("lgpl-2.0", VERSIONED, "lesser", f"(?:gnu )?lesser general public(?: {L})?(?: version| v)? 2(?: 0)?"),
    ("lgpl-3.0", VERSIONED, "lesser", f"(?:gnu )?lesser general public(?: {L})?(?: version| v)? 3(?: 0)?"),
    ("lgpl-2.1", VERSIONED, "library", f"(?:gnu )?library general public(?: {L})?(?: version| v)? 2 1"),
    ("lgpl-2.0", VERSIONED, "library", f"(?:gnu )?library general public(?: {L})?(?: version| v)? 2(?: 0)?"),
    ("lgpl-3.0", VERSIONED, "library", f"(?:gnu )?library general public(?: {L})?(?: version| v)? 3(?: 0)?"),
    ("lgpl-2.1", VERSIONED, "lgpl", f"(?:gnu )?lgpl(?: {L})?(?: version)? v?2 1"),
    ("lgpl-2.0", VERSIONED, "lgpl", f"(?:gnu )?lgpl(?: {L})?(?: version)? v?2(?: 0)?"),
    ("lgpl-3.0", VERSIONED, "lgpl", f"(?:gnu )?lgpl(?: {L})?(?: version)? v?3(?: 0)?"),
    ("lgpl-2.1", VERSIONED, "lgplv2", "lgplv2 1"),
    ("lgpl-3.0", VERSIONED, "lgplv3", "lgplv3"),
    ("lgpl", NAMED, "lesser", f"(?:gnu )?lesser general public {L}"),
    ("lgpl", NAMED, "library", f"(?:gnu )?library general public {L}"),
    ("lgpl", NAMED, "lgpl", f"(?:gnu )?lgpl {L}"),
    ("lgpl", NAMED, "gnu", "gnu org licenses lgpl(?: 2 1| 3 0)?(?: html| txt)?"),
    ("lgpl", SHORT, "lgpl", "(?:gnu )?lgpl"),
    ("agpl-1.0", SPDX, "spdx", f"{TAG} agpl 1 0(?: only| or later)?"),
    ("agpl-3.0", SPDX, "spdx", f"{TAG} agpl 3 0(?: only| or later)?"),
    ("agpl-3.0", TEXT, "affero", "gnu affero general public license version 3 19 november 2007"),
    ("agpl-1.0", GRANT, "affero", f"{G} affero general public(?: {L})?(?: version)? 1(?: 0)?(?: or later)?"),
    ("agpl-3.0", GRANT, "affero", f"{G} affero general public(?: {L})?(?: version)? 3(?: 0)?(?: or later)?"),
    ("agpl", GRANT, "affero", f"{G} affero general public(?: {L})?"),
    ("agpl-3.0", GRANT, "agpl", f"{G} agpl(?: version)? v?3(?: 0)?(?: or later)?"),
    ("agpl", GRANT, "agpl", f"{G} agpl"),
    ("agpl-1.0", VERSIONED, "affero", f"(?:gnu )?affero general public(?: {L})?(?: version| v)? 1(?: 0)?"),
    ("agpl-3.0", VERSIONED, "affero", f"(?:gnu )?affero general public(?: {L})?(?: version| v)? 3(?: 0)?"),
    ("agpl-1.0", VERSIONED, "agpl", "(?:gnu )?agpl(?: version)? v?1(?: 0)?"),
    ("agpl-3.0", VERSIONED, "agpl", "(?:gnu )?agpl(?: version)? v?3(?: 0)?"),
    ("agpl-3.0", VERSIONED, "agplv3", "agplv3"),
    ("agpl", NAMED, "affero", f"(?:gnu )?affero general public {L}"),
    ("agpl", NAMED, "agpl", f"(?:gnu )?agpl {L}"),
    ("agpl", SHORT, "agpl", "(?:gnu )?agpl"),
    ("sspl-1.0", SPDX, "spdx", f"{TAG} sspl 1 0"),
    ("sspl-1.0", VERSIONED, "server", f"server side public(?: {L})?(?: version| v)? 1(?: 0)?"),
    ("sspl", NAMED, "server", f"server side public {L}"),
    ("gfdl-1.1", SPDX, "spdx", f"{TAG} gfdl 1 1(?: only| or later)?"),
    ("gfdl-1.2", SPDX, "spdx", f"{TAG} gfdl 1 2(?: only| or later)?"),
    ("gfdl-1.3", SPDX, "spdx", f"{TAG} gfdl 1 3(?: only| or later)?"),
    ("gfdl", GRANT, "documentation", f"{G} free documentation(?: {L})?"),
    ("gfdl-1.1", VERSIONED, "documentation", f"(?:gnu )?free documentation(?: {L})?(?: version)? 1 1"),
    ("gfdl-1.2", VERSIONED, "documentation", f"(?:gnu )?free documentation(?: {L})?(?: version)? 1 2"),
    ("gfdl-1.3", VERSIONED, "documentation", f"(?:gnu )?free documentation(?: {L})?(?: version)? 1 3"),
    ("gfdl", NAMED, "documentation", f"(?:gnu )?free documentation {L}"),
    ("gfdl", SHORT, "gfdl", "gfdl"),
]

WEAK_COPYLEFT: list[Rule] = [
    ("mpl-1.0", SPDX, "spdx", f"{TAG} mpl 1 0"),
    ("mpl-1.1", SPDX, "spdx", f"{TAG} mpl 1 1"),
    ("mpl-2.0", SPDX, "spdx", f"{TAG} mpl 2 0(?: no copyleft exception)?"),
    ("mpl", TEXT, "mozilla", "this source code form is subject to the terms of the mozilla public license"),
    ("mpl-2.0", TEXT, "mozilla", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("mpl-1.1", TEXT, "mozilla", "the contents of this file are subject to the mozilla public license version 1 1"),
    ("mpl-1.0", GRANT, "mozilla", f"{G} mozilla public(?: {L})?(?: version| v)? 1 0"),
    ("mpl-1.1", GRANT, "mozilla", f"{G} mozilla public(?: {L})?(?: version| v)? 1 1"),
    ("mpl-2.0", GRANT, "mozilla", f"{G} mozilla public(?: {L})?(?: version| v)? 2 0"),
    ("mpl", GRANT, "mozilla", f"{G} mozilla public(?: {L})?"),
    ("mpl-2.0", GRANT, "mpl", f"{G} mpl(?: {L})?(?: version| v)? 2 0"),
    ("mpl", GRANT, "mpl", f"{G} mpl(?: {L})?"),
    ("mpl-1.0", VERSIONED, "mozilla", f"mozilla public(?: {L})?(?: version| v)? 1 0"),
    ("mpl-1.1", VERSIONED, "mozilla", f"mozilla public(?: {L})?(?: version| v)? 1 1"),
    ("mpl-2.0", VERSIONED, "mozilla", f"mozilla public(?: {L})?(?: version| v)? 2 0"),
    ("mpl-1.0", VERSIONED, "mpl", f"mpl(?: {L})?(?: version| v)? 1 0"),
    ("mpl-1.1", VERSIONED, "mpl", f"mpl(?: {L})?(?: version| v)? 1 1"),
    ("mpl-2.0", VERSIONED, "mpl", f"mpl(?: {L})?(?: version| v)? 2 0"),
    ("mpl-2.0", VERSIONED, "mozilla", "mozilla org (?:en us )?mpl 2 0"),
    ("mpl", NAMED, "mozilla", f"mozilla public {L}"),
    ("mpl", NAMED, "mpl", f"mpl {L}"),
    ("mpl", SHORT, "mpl", f"{B} (?:[^ ]+ ){{0,2}}mpl"),
    ("mpl", SHORT, "mpl", f"mpl (?:[^ ]+ ){{0,2}}{B}"),
    ("epl-1.0", SPDX, "spdx", f"{TAG} epl 1 0"),
    ("epl-2.0", SPDX, "spdx", f"{TAG} epl 2 0"),
    ("epl", TEXT, "eclipse", "this program and the accompanying materials are made available under the terms of the eclipse public license"),
    ("epl-1.0", GRANT, "eclipse", f"{G} eclipse public(?: {L})?(?: version| v)? 1 0"),
    ("epl-2.0", GRANT, "eclipse", f"{G} eclipse public(?: {L})?(?: version| v)? 2 0"),
    ("epl", GRANT, "eclipse", f"{G} eclipse public(?: {L})?"),
    ("epl-1.0", VERSIONED, "eclipse", f"eclipse public(?: {L})?(?: version| v)? 1 0"),
    ("epl-2.0", VERSIONED, "eclipse", f"eclipse public(?: {L})?(?: version| v)? 2 0"),
    ("edl-1.0", VERSIONED, "eclipse", f"eclipse distribution(?: {L})?(?: version| v)? 1 0"),
    ("epl", NAMED, "eclipse", f"eclipse public {L}"),
    ("edl", NAMED, "eclipse", f"eclipse distribution {L}"),
    ("epl-2.0", VERSIONED, "epl", f"epl(?: {L})?(?: version| v)? 2 0"),
    ("epl-1.0", VERSIONED, "epl", f"epl(?: {L})?(?: version| v)? 1 0"),
    ("cddl-1.0", SPDX, "spdx", f"{TAG} cddl 1 0"),
    ("cddl-1.1", SPDX, "spdx", f"{TAG} cddl 1 1"),
    ("cddl", GRANT, "distribution", f"{G} common development and distribution(?: {L})?"),
    ("cddl", GRANT, "cddl", f"{G} cddl"),
    ("cddl-1.0", VERSIONED, "distribution", f"common development and distribution(?: {L})?(?: version)? 1 0"),
    ("cddl-1.1", VERSIONED, "distribution", f"common development and distribution(?: {L})?(?: version)? 1 1"),
    ("cddl-1.0", VERSIONED, "cddl", f"cddl(?: {L})?(?: version)? 1 0"),
    ("cddl-1.1", VERSIONED, "cddl", f"cddl(?: {L})?(?: version)? 1 1"),
    ("cddl", NAMED, "distribution", f"common development and distribution(?: {L})?"),
    ("cddl", SHORT, "cddl", "cddl"),
    ("eupl-1.0", SPDX, "spdx", f"{TAG} eupl 1 0"),
    ("eupl-1.1", SPDX, "spdx", f"{TAG} eupl 1 1"),
    ("eupl-1.2", SPDX, "spdx", f"{TAG} eupl 1 2"),
    ("eupl", GRANT, "european", f"{G} european union public(?: {L})?"),
    ("eupl", GRANT, "eupl", f"{G} eupl"),
    ("eupl-1.0", VERSIONED, "european", f"european union public(?: {L})?(?: version| v)? 1 0"),
    ("eupl-1.1", VERSIONED, "european", f"european union public(?: {L})?(?: version| v)? 1 1"),
    ("eupl-1.2", VERSIONED, "european", f"european union public(?: {L})?(?: version| v)? 1 2"),
    ("eupl-1.1", VERSIONED, "eupl", f"eupl(?: {L})?(?: version| v)? 1 1"),
    ("eupl-1.2", VERSIONED, "eupl", f"eupl(?: {L})?(?: version| v)? 1 2"),
    ("eupl", NAMED, "european", f"european union public(?: {L})?"),
    ("eupl", SHORT, "eupl", "eupl"),
    ("cpl-1.0", VERSIONED, "common", f"common public {L}(?: version| v)? 1 0"),
    ("cpl", NAMED, "common", f"common public {L}"),
    ("ipl-1.0", NAMED, "ibm", f"ibm public {L}(?: version)?(?: 1 0)?"),
    ("apsl-2.0", VERSIONED, "apple", f"apple public source {L}(?: version)? 2 0"),
    ("apsl", NAMED, "apple", f"apple public source {L}"),
    ("artistic-1.0", SPDX, "spdx", f"{TAG} artistic 1 0(?: perl| cl8)?"),
    ("artistic-2.0", SPDX, "spdx", f"{TAG} artistic 2 0"),
    ("artistic", GRANT, "artistic", f"{G} (?:perl )?artistic(?: {L})?"),
    ("artistic-1.0", VERSIONED, "artistic", f"(?:perl )?artistic {L}(?: version)? 1 0"),
    ("artistic-2.0", VERSIONED, "artistic", f"(?:perl )?artistic {L}(?: version)? 2 0"),
    ("artistic", NAMED, "artistic", f"(?:perl )?artistic {L}"),
    ("perl", GRANT, "perl", "under the same terms as perl itself"),
    ("osl-3.0", VERSIONED, "open", f"open software {L}(?: version| v)? 3 0"),
    ("osl", NAMED, "open", f"open software {L}"),
    ("cecill", NAMED, "cecill", f"cecill(?: b| c)?(?: {L})?(?: 2 1| 2 0)?"),
    ("qpl-1.0", NAMED, "q", f"q public {L}(?: version 1 0)?"),
    ("sleepycat", NAMED, "sleepycat", f"sleepycat {L}"),
    ("lppl-1.3", VERSIONED, "latex", f"latex project public {L}(?: version)? 1 3c?"),
    ("lppl", NAMED, "latex", f"latex project public {L}"),
]

CONTENT: list[Rule] = [
    ("cc0-1.0", SPDX, "spdx", f"{TAG} cc0 1 0"),
    ("cc0-1.0", TEXT, "cc0", "cc0 1 0 universal(?: public domain dedication)?"),
    ("cc0-1.0", VERSIONED, "zero", f"creative commons zero(?: {L})?(?: version| v)? 1 0"),
    ("cc0-1.0", VERSIONED, "cc0", "cc0(?: version| v)? 1 0"),
    ("cc0-1.0", NAMED, "creativecommons", "creativecommons org publicdomain zero 1 0"),
    ("cc0", NAMED, "zero", "creative commons zero"),
    ("cc0", SHORT, "cc0", "cc0"),
    ("cc-by", SPDX, "spdx", f"{TAG} cc by (?:1 0|2 0|2 5|3 0|4 0)"),
    ("cc-by-sa", SPDX, "spdx", f"{TAG} cc by sa (?:1 0|2 0|2 5|3 0|4 0)"),
    ("cc-by-nc", SPDX, "spdx", f"{TAG} cc by nc (?:1 0|2 0|2 5|3 0|4 0)"),
    ("cc-by-nd", SPDX, "spdx", f"{TAG} cc by nd (?:1 0|2 0|2 5|3 0|4 0)"),
    ("cc-by-nc-sa", SPDX, "spdx", f"{TAG} cc by nc sa (?:1 0|2 0|2 5|3 0|4 0)"),
    ("cc-by-nc-nd", SPDX, "spdx", f"{TAG} cc by nc nd (?:1 0|2 0|2 5|3 0|4 0)"),
    ("cc-by-2.0", VERSIONED, "cc", "cc by 2 0"),
    ("cc-by-2.5", VERSIONED, "cc", "cc by 2 5"),
    ("cc-by-3.0", VERSIONED, "cc", "cc by 3 0"),
    ("cc-by-4.0", VERSIONED, "cc", "cc by 4 0"),
    ("cc-by-sa-2.0", VERSIONED, "cc", "cc by sa 2 0"),
    ("cc-by-sa-2.5", VERSIONED, "cc", "cc by sa 2 5"),
    ("cc-by-sa-3.0", VERSIONED, "cc", "cc by sa 3 0"),
    ("cc-by-sa-4.0", VERSIONED, "cc", "cc by sa 4 0"),
    ("cc-by-nc-2.0", VERSIONED, "cc", "cc by nc 2 0"),
    ("cc-by-nc-3.0", VERSIONED, "cc", "cc by nc 3 0"),
    ("cc-by-nc-4.0", VERSIONED, "cc", "cc by nc 4 0"),
    ("cc-by-nd-3.0", VERSIONED, "cc", "cc by nd 3 0"),
    ("cc-by-nd-4.0", VERSIONED, "cc", "cc by nd 4 0"),
    ("cc-by-nc-sa-3.0", VERSIONED, "cc", "cc by nc sa 3 0"),
    ("cc-by-nc-sa-4.0", VERSIONED, "cc", "cc by nc sa 4 0"),
    ("cc-by-nc-nd-3.0", VERSIONED, "cc", "cc by nc nd 3 0"),
    ("cc-by-nc-nd-4.0", VERSIONED, "cc", "cc by nc nd 4 0"),
    ("cc-by-3.0", VERSIONED, "creative", f"creative commons attribution(?: {L})?(?: version)? 3 0(?: unported| international)?"),
    ("cc-by-4.0", VERSIONED, "creative", f"creative commons attribution(?: {L})?(?: version)? 4 0(?: international)?"),
    ("cc-by-sa-3.0", VERSIONED, "creative", f"creative commons attribution share ?alike(?: {L})?(?: version)? 3 0(?: unported)?"),
    ("cc-by-sa-4.0", VERSIONED, "creative", f"creative commons attribution share ?alike(?: {L})?(?: version)? 4 0(?: international)?"),
    ("cc-by-nc-3.0", VERSIONED, "creative", f"creative commons attribution non ?commercial(?: {L})?(?: version)? 3 0(?: unported)?"),
    ("cc-by-nc-4.0", VERSIONED, "creative", f"creative commons attribution non ?commercial(?: {L})?(?: version)? 4 0(?: international)?"),
    ("cc-by-nd-4.0", VERSIONED, "creative", f"creative commons attribution no ?deriv(?:ative)?s(?: works)?(?: {L})?(?: version)? 4 0(?: international)?"),
    ("cc-by-nc-sa-4.0", VERSIONED, "creative", f"creative commons attribution non ?commercial share ?alike(?: {L})?(?: version)? 4 0(?: international)?"),
    ("cc-by-nc-nd-4.0", VERSIONED, "creative", f"creative commons attribution non ?commercial no ?deriv(?:ative)?s(?: works)?(?: {L})?(?: version)? 4 0(?: international)?"),
    ("cc-by", GRANT, "cc", f"{G} (?:an? )?cc by"),
    ("cc-by-sa", GRANT, "cc", f"{G} (?:an? )?cc by sa"),
    ("cc-by-nc", GRANT, "cc", f"{G} (?:an? )?cc by nc"),
    ("cc-by-nc-4.0", GRANT, "cc", f"{G} (?:an? )?cc by nc 4 0"),
    ("cc-by-4.0", GRANT, "cc", f"{G} (?:an? )?cc by 4 0"),
    ("cc-by-sa-4.0", GRANT, "cc", f"{G} (?:an? )?cc by sa 4 0"),
    ("cc-by-nc-nd", GRANT, "cc", f"{G} (?:an? )?cc by nc nd"),
    ("cc-by-nc-sa", GRANT, "cc", f"{G} (?:an? )?cc by nc sa"),
    ("cc", GRANT, "creative", f"{G} (?:an? )?creative commons(?: {L})?"),
    ("cc-by", NAMED, "cc", "cc by"),
    ("cc-by-sa", NAMED, "cc", "cc by sa"),
    ("cc-by-nc", NAMED, "cc", "cc by nc"),
    ("cc-by-nd", NAMED, "cc", "cc by nd"),
    ("cc-by-nc-sa", NAMED, "cc", "cc by nc sa"),
    ("cc-by-nc-nd", NAMED, "cc", "cc by nc nd"),
    ("cc-by", NAMED, "creative", f"creative commons attribution(?: {L})?"),
    ("cc-by-sa", NAMED, "creative", f"creative commons attribution share ?alike(?: {L})?"),
    ("cc-by-nc", NAMED, "creative", f"creative commons attribution non ?commercial(?: {L})?"),
    ("cc-by-nd", NAMED, "creative", f"creative commons attribution no ?deriv(?:ative)?s(?: works)?(?: {L})?"),
    ("cc-by-nc-sa", NAMED, "creative", f"creative commons attribution non ?commercial share ?alike(?: {L})?"),
    ("cc-by-nc-nd", NAMED, "creative", f"creative commons attribution non ?commercial no ?deriv(?:ative)?s(?: works)?(?: {L})?"),
    ("cc-by", NAMED, "creativecommons", "creativecommons org licenses by(?: [1-4] [05])?"),
    ("cc-by-sa", NAMED, "creativecommons", "creativecommons org licenses by sa(?: [1-4] [05])?"),
    ("cc-by-nc", NAMED, "creativecommons", "creativecommons org licenses by nc(?: [1-4] [05])?"),
    ("cc-by-nd", NAMED, "creativecommons", "creativecommons org licenses by nd(?: [1-4] [05])?"),
    ("cc-by-nc-sa", NAMED, "creativecommons", "creativecommons org licenses by nc sa(?: [1-4] [05])?"),
    ("cc-by-nc-nd", NAMED, "creativecommons", "creativecommons org licenses by nc nd(?: [1-4] [05])?"),
    ("cc", SHORT, "creative", f"creative commons(?: {L})?"),
    ("ofl-1.0", SPDX, "spdx", f"{TAG} ofl 1 0"),
    ("ofl-1.1", SPDX, "spdx", f"{TAG} ofl 1 1"),
    ("ofl", TEXT, "sil", f"this font software is licensed under the sil open font {L}"),
    ("ofl-1.1", TEXT, "sil", f"this font software is licensed under the sil open font {L} version 1 1"),
    ("ofl-1.0", VERSIONED, "sil", f"sil open font(?: {L})?(?: version)? 1 0"),
    ("ofl-1.1", VERSIONED, "sil", f"sil open font(?: {L})?(?: version)? 1 1"),
    ("ofl", NAMED, "sil", f"sil open font {L}"),
    ("ofl", NAMED, "ofl", f"ofl {L}"),
    ("odbl-1.0", SPDX, "spdx", f"{TAG} odbl 1 0"),
    ("odbl-1.0", VERSIONED, "database", f"open(?: data commons)?(?: open)? database {L}(?: version| v)? 1 0"),
    ("odbl", NAMED, "database", f"open(?: data commons)?(?: open)? database {L}"),
    ("odbl", SHORT, "odbl", "odbl"),
    ("odc-by-1.0", NAMED, "commons", f"open data commons attribution {L}(?: v1 0| version 1 0)?"),
    ("pddl-1.0", NAMED, "dedication", "public domain dedication and license(?: v1 0)?"),
    ("ogl-3.0", VERSIONED, "government", f"open government {L}(?: v3 0| version 3 0)"),
    ("ogl", NAMED, "government", f"open government {L}"),
    ("public-domain", TEXT, "domain", "(?:is|are|dedicated to|released into|placed in|placed into|in) the public domain"),
    ("public-domain", TEXT, "domain", "public domain mark(?: 1 0)?"),
]

OTHER: list[Rule] = [
    ("proprietary", TEXT, "confidential", "proprietary and confidential"),
    ("proprietary", TEXT, "confidential", "confidential and proprietary"),
    ("proprietary", TEXT, "prohibited", "unauthorized (?:copying|reproduction|use)(?: or distribution)?(?: of this \\w+)? is(?: strictly)? prohibited"),
    ("proprietary", TEXT, "permission", "may not be reproduced(?: or distributed)?(?: in any form)? without(?: the)?(?: prior)?(?: written)? permission"),
    ("proprietary", TEXT, "trade", "(?:valuable )?trade secrets(?: and confidential information)? of"),
    ("proprietary", NAMED, "proprietary", f"proprietary(?: software)? {L}"),
    ("proprietary", NAMED, "internal", "for internal use only"),
    ("commercial", NAMED, "commercial", f"commercial {L}(?: agreement)?"),
    ("eula", NAMED, "eula", "eula"),
    ("eula", NAMED, "end", f"end user {L} agreement"),
    ("non-commercial", NAMED, "commercial", "for non commercial (?:use|purposes)(?: only)?"),
    ("non-commercial", NAMED, "noncommercial", "(?:for )?noncommercial use only"),
    ("research-only", NAMED, "research", "for(?: academic)? research (?:use|purposes) only"),
    ("busl-1.1", SPDX, "spdx", f"{TAG} busl 1 1"),
    ("busl-1.1", VERSIONED, "business", f"business source {L} 1 1"),
    ("busl", NAMED, "business", f"business source {L}"),
    ("elastic-2.0", VERSIONED, "elastic", f"elastic {L} 2 0"),
    ("elastic", NAMED, "elastic", f"elastic {L}"),
    ("commons-clause", NAMED, "clause", "commons clause(?: license condition v1 0)?"),
    ("polyform", NAMED, "polyform", f"polyform (?:noncommercial|small business|shield|strict|perimeter) {L}(?: 1 0 0)?"),
    ("openrail", NAMED, "openrail", f"(?:bigscience |creativeml )?openrail(?: m| d)?(?: {L})?"),
    ("openrail", NAMED, "responsible", f"responsible ai {L}"),
    ("openrail", NAMED, "rail", f"rail(?: m)? {L}"),
    ("warranty", TEXT, "warranty", "(?:without|no) warranty of any kind"),
    ("warranty", TEXT, "warranties", "without warranties or conditions of any kind"),
    ("warranty", TEXT, "warranty", "comes with absolutely no warranty"),
    ("warranty", NAMED, "liable", "in no event shall the (?:authors?|copyright holders?|contributors?)(?: or(?: copyright holders| contributors))? be liable"),
    ("licensed", SHORT, "licensed", "licensed under"),
    ("licensed", SHORT, "licenced", "licenced under"),
    ("copyright", SHORT, "copyright", "copyright(?: c)? (?:19|20)[0-9][0-9]"),
    ("copyright", SHORT, "copr", "copr(?: c)? (?:19|20)[0-9][0-9]"),
]

RULES = PERMISSIVE + COPYLEFT + WEAK_COPYLEFT + CONTENT + OTHER
