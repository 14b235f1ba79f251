"""Signature rules of the licence scan.

Rules read a normalised text: lower-case words with one space before each and one after
the last. A rule is (label, priority, confidence, keyword, regex); the keyword is a plain
substring that every match contains, tested before the regex. Every regex starts with the
space before its first word and looks ahead for the space after its last one, so rules
match whole words. Priorities: 4 tag, 3 wording of the licence itself, 2 grant, 1 mention.
"""

from __future__ import annotations

#: The phrases every scan reports, with their labels (fixed values).
BASE_PHRASES = [("gnu general public license", "gpl"), ("apache license", "apache"),
                ("cc by", "cc-by"), ("mit license", "mit")]

#: label, keyword, name as a regex over normalised words
NAMES = [
    ("gpl-1.0", "gnu", r"gnu (?:general public license|gpl) (?:version |v ?)1(?: 0)?"),
    ("gpl-2.0", "gnu", r"gnu (?:general public license|gpl) (?:version |v ?)2(?: 0)?"),
    ("gpl-3.0", "gnu", r"gnu (?:general public license|gpl) (?:version |v ?)3(?: 0)?"),
    ("gpl", "gpl", r"gpl ?v?[123](?: 0)?"),
    ("lgpl-2.0", "gnu", r"gnu library general public license(?: (?:version |v ?)2(?: 0)?)?"),
    ("lgpl-2.1", "gnu", r"gnu lesser general public license (?:version |v ?)2 1"),
    ("lgpl-3.0", "gnu", r"gnu lesser general public license (?:version |v ?)3(?: 0)?"),
    ("lgpl", "gnu", r"gnu lesser general public license"),
    ("agpl-3.0", "affero", r"gnu affero general public license(?: (?:version |v ?)3(?: 0)?)?"),
    ("gfdl", "gnu", r"gnu free documentation license(?: (?:version |v ?)1(?: [0-3])?)?"),
    ("apache-1.1", "apache", r"apache (?:software )?license (?:version |v ?)?1 1"),
    ("apache-2.0", "apache", r"apache (?:software )?license (?:version |v ?)?2(?: 0)?"),
    ("apache", "apache", r"apache software license"),
    ("mit", "mit", r"mit(?: x11)? licen[cs]e"),
    ("mit", "expat", r"expat licen[cs]e"),
    ("x11", "x11", r"x11 licen[cs]e"),
    ("mit-0", "mit", r"mit (?:0|no attribution) licen[cs]e"),
    ("isc", "isc", r"isc licen[cs]e"),
    ("bsd-2-clause", "bsd", r"(?:bsd 2 clause|2 clause bsd|simplified bsd|freebsd) licen[cs]e"),
    ("bsd-3-clause", "bsd", r"(?:bsd 3 clause|3 clause bsd|new bsd|modified bsd|revised bsd) licen[cs]e"),
    ("bsd-4-clause", "bsd", r"(?:bsd 4 clause|4 clause bsd|original bsd) licen[cs]e"),
    ("bsd", "bsd", r"bsd (?:style )?licen[cs]e"),
    ("0bsd", "bsd", r"(?:zero clause bsd|bsd zero clause|0bsd)(?: licen[cs]e)?"),
    ("mpl-1.1", "mozilla", r"mozilla public license (?:version |v ?)?1 1"),
    ("mpl-2.0", "mozilla", r"mozilla public license (?:version |v ?)?2(?: 0)?"),
    ("mpl", "mozilla", r"mozilla public license"),
    ("epl-1.0", "eclipse", r"eclipse public license (?:version |v ?)?1(?: 0)?"),
    ("epl-2.0", "eclipse", r"eclipse public license (?:version |v ?)?2(?: 0)?"),
    ("epl", "eclipse", r"eclipse public license"),
    ("edl", "eclipse", r"eclipse distribution license(?: (?:version |v ?)?1(?: 0)?)?"),
    ("cddl-1.0", "common development", r"common development and distribution license(?: (?:version |v ?)?1(?: [01])?)?"),
    ("cpl-1.0", "common public", r"common public license(?: (?:version |v ?)?1(?: 0)?)?"),
    ("eupl", "european union public", r"european union public licen[cs]e(?: (?:version |v ?)?1(?: [012])?)?"),
    ("artistic-1.0", "artistic", r"artistic license (?:version |v ?)?1(?: 0)?"),
    ("artistic-2.0", "artistic", r"artistic license (?:version |v ?)?2(?: 0)?"),
    ("artistic", "artistic", r"artistic license"),
    ("zlib", "zlib", r"zlib(?: libpng)? licen[cs]e"),
    ("libpng", "libpng", r"libpng licen[cs]e"),
    ("boost-1.0", "boost", r"boost software license(?: (?:version |v ?)?1(?: 0)?)?"),
    ("unlicense", "unlicense", r"(?:the )?unlicense"),
    ("wtfpl", "wtfpl", r"wtfpl"),
    ("wtfpl", "what the fuck you want", r"do what the fuck you want to public license"),
    ("ms-pl", "microsoft", r"microsoft public license"),
    ("ms-rl", "microsoft", r"microsoft reciprocal license"),
    ("python-2.0", "python", r"(?:python software foundation|psf|python) license(?: (?:version |v ?)?2(?: 0)?)?"),
    ("php-3.01", "php", r"php license(?: (?:version |v ?)?3(?: 01?)?)?"),
    ("ruby", "ruby", r"ruby license"),
    ("perl", "perl", r"same terms as perl itself"),
    ("postgresql", "postgresql", r"postgresql licen[cs]e"),
    ("openssl", "openssl", r"openssl license"),
    ("ofl-1.1", "open font", r"(?:sil )?open font license(?: (?:version |v ?)?1(?: [01])?)?"),
    ("ncsa", "ncsa", r"(?:university of illinois )?ncsa (?:open source )?license"),
    ("afl-3.0", "academic free", r"academic free license(?: (?:version |v ?)?3(?: 0)?)?"),
    ("osl-3.0", "open software license", r"open software license(?: (?:version |v ?)?3(?: 0)?)?"),
    ("cecill", "cecill", r"cecill(?: [abc])?(?: licen[cs]e)?(?: (?:version |v ?)?2(?: [01])?)?"),
    ("vim", "vim", r"vim licen[cs]e"),
    ("odbl-1.0", "open database", r"(?:odc )?open database licen[cs]e(?: (?:version |v ?)?1(?: 0)?)?"),
    ("odc-by-1.0", "open data commons", r"open data commons attribution licen[cs]e"),
    ("pddl-1.0", "public domain dedication and", r"public domain dedication and licen[cs]e"),
    ("cdla-permissive", "community data", r"community data license agreement permissive"),
    ("cdla-sharing", "community data", r"community data license agreement sharing"),
    ("cc0-1.0", "cc0", r"cc0(?: 1 0)?(?: universal)?"),
    ("cc0-1.0", "creative commons", r"creative commons zero(?: (?:version |v ?)?1(?: 0)?)?"),
    ("cc-by-nc-nd", "cc by nc nd", r"cc by nc nd(?: (?:version |v ?)?[1-4](?: [05])?)?"),
    ("cc-by-nc-sa", "cc by nc sa", r"cc by nc sa(?: (?:version |v ?)?[1-4](?: [05])?)?"),
    ("cc-by-nc", "cc by nc", r"cc by nc(?: (?:version |v ?)?[1-4](?: [05])?)?"),
    ("cc-by-nd", "cc by nd", r"cc by nd(?: (?:version |v ?)?[1-4](?: [05])?)?"),
    ("cc-by-sa", "cc by sa", r"cc by sa(?: (?:version |v ?)?[1-4](?: [05])?)?"),
    ("cc-by-4.0", "cc by", r"cc by (?:version |v ?)?4 0"),
    ("cc-by-3.0", "cc by", r"cc by (?:version |v ?)?3 0"),
    ("cc-by", "creative commons", r"creative commons attribution(?: [1-4] [05])?(?: international| unported)?"),
    ("cc-by-sa", "creative commons", r"creative commons attribution share ?alike(?: [1-4] [05])?"),
    ("cc-by-nc", "creative commons", r"creative commons attribution non ?commercial(?: [1-4] [05])?"),
    ("cc-by-nd", "creative commons", r"creative commons attribution no ?deriv(?:ative|ative work)?s(?: [1-4] [05])?"),
]

#: SPDX identifiers for tags (normalised: "spdx license identifier mit")
SPDX = ("gpl 1 0 only;gpl 2 0 only;gpl 2 0 or later;gpl 3 0 only;gpl 3 0 or later;lgpl 2 1 only;lgpl 2 1 or later;"
        "lgpl 3 0 only;lgpl 3 0 or later;agpl 3 0 only;agpl 3 0 or later;apache 1 1;apache 2 0;mit;mit 0;x11;isc;"
        "bsd 2 clause;bsd 3 clause;bsd 4 clause;0bsd;mpl 1 1;mpl 2 0;epl 1 0;epl 2 0;cddl 1 0;cpl 1 0;eupl 1 2;"
        "artistic 2 0;zlib;libpng;bsl 1 0;unlicense;wtfpl;ms pl;ms rl;python 2 0;php 3 01;ruby;postgresql;openssl;"
        "ofl 1 1;ncsa;afl 3 0;osl 3 0;cecill 2 1;vim;odbl 1 0;cc0 1 0;cc by 4 0;cc by sa 4 0;cc by nc 4 0;"
        "cc by nd 4 0;cc by nc sa 4 0;cc by nc nd 4 0").split(";")

#: label, keyword, wording of the licence text itself
WORDINGS = [
    ("mit", "permission is hereby granted", r"permission is hereby granted free of charge to any person obtaining a copy"),
    ("isc", "permission to use copy", r"permission to use copy modify and (?:or )?distribute this software for any purpose with or without fee"),
    ("bsd", "redistribution and use", r"redistribution and use in source and binary forms with or without modification are permitted"),
    ("bsd-3-clause", "endorse or promote", r"neither the name of (?:[^ ]+ ){1,12}nor the names of its contributors may be used to endorse or promote"),
    ("bsd-4-clause", "advertising materials", r"all advertising materials mentioning features or use of this software must display"),
    ("apache-2.0", "except in compliance", r"you may not use this file except in compliance with the license"),
    ("apache-2.0", "apache", r"licensed to the apache software foundation"),
    ("gpl", "free software foundation", r"redistribute it and or modify it under the terms of the gnu general public license"),
    ("gpl", "or at your option", r"or at your option any later version"),
    ("lgpl", "lesser", r"redistribute it and or modify it under the terms of the gnu lesser general public license"),
    ("agpl-3.0", "affero", r"under the terms of the gnu affero general public license"),
    ("mpl-2.0", "mozilla", r"this source code form is subject to the terms of the mozilla public license"),
    ("zlib", "as is without any express", r"this software is provided as is without any express or implied warranty"),
    ("boost-1.0", "boost", r"distributed under the boost software license"),
    ("unlicense", "released into the public domain", r"this is free and unencumbered software released into the public domain"),
    ("public-domain", "public domain", r"(?:dedicated|released|placed) (?:in)?to the public domain"),
    ("public-domain", "public domain", r"is in the public domain"),
    ("cc0-1.0", "waived all copyright", r"has waived all copyright and related (?:or|and) neighboring rights"),
    ("epl", "eclipse", r"this program and the accompanying materials are made available under the terms of the eclipse public license"),
    ("ofl-1.1", "open font", r"this font software is licensed under the sil open font license"),
    ("artistic", "perl", r"under the same terms as perl itself"),
    ("proprietary", "all rights reserved", r"all rights reserved"),
    ("proprietary", "confidential", r"proprietary and confidential"),
    ("no-derivatives", "written permission", r"without (?:the )?(?:prior |express )?written permission of the (?:author|owner|publisher|copyright holder)s?"),
]


def rules() -> list[tuple[str, int, float, str, str, bool]]:
    """All rules in order: (label, priority, confidence, keyword, regex, base)."""
    out = [(label, 1, 0.9, phrase, f" {phrase}(?= )", True) for phrase, label in BASE_PHRASES]
    out += [("spdx-" + tag.replace(" ", "-"), 4, 1.0, "spdx license identifier", f" spdx license identifier {tag}(?= )", False) for tag in SPDX]
    out += [(label, 3, 0.95, key, f" {text}(?= )", False) for label, key, text in WORDINGS]
    grants = r"(?:licen[cs]ed|released|distributed|available|provided|published|covered|used|redistributed) (?:under|by) (?:the )?(?:terms (?:and conditions )?of )?(?:the )?"
    out += [(label, 2, 0.9, key, f" {grants}{name}(?= )", False) for label, key, name in NAMES]
    out += [(label, 2, 0.85, key, f" (?:see|read|copy of|subject to|according to) (?:the )?(?:terms of )?(?:the )?{name}(?= )", False) for label, key, name in NAMES]
    out += [(label, 1, 0.7, key, f" {name}(?= )", False) for label, key, name in NAMES]
    return out
