"""Signatures of licences: what to look for, in order of priority.

Patterns are regular expressions over normalised text: words of lower-case letters and digits with one space between
them, so ``Apache License, Version 2.0`` reads ``apache license version 2 0``. ``...`` stands for up to eight words. A
pattern is only tried on texts that hold its keyword.

Lower priorities are stronger: 1 tags, 2 whole notices, 3 names with a version, 4 names, 5 general remarks.
"""

from __future__ import annotations

import itertools
import re
from typing import NamedTuple

TAG, NOTICE, VERSIONED, NAMED, GENERAL = 1, 2, 3, 4, 5
#: How far a detection of each priority is trusted.
WEIGHTS = {TAG: 0.99, NOTICE: 0.95, VERSIONED: 0.9, NAMED: 0.7, GENERAL: 0.4}
GAP = "..."

V2 = r"(?: version| v| ver)? ?2(?: 0)?"
V3 = r"(?: version| v| ver)? ?3(?: 0)?"
LATER = r" or (?:at your option )?any later version"
ONLY = r" only"

#: (label, priority, keyword, pattern)
WRITTEN = [
    # Permissive
    ("mit", NOTICE, "permission is hereby granted", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("mit", NOTICE, "above copyright notice and this permission", "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"),
    ("mit", VERSIONED, "mit licen", "(?:released|licensed|distributed|available|published) under the (?:terms of the )?mit licen[cs]e"),
    ("mit", NAMED, "mit licen", "(?:the )?mit licen[cs]e"),
    ("mit", NAMED, "expat licen", "expat licen[cs]e"),
    ("mit-0", NOTICE, "mit no attribution", "mit no attribution"),
    ("x11", NAMED, "x11 licen", "(?:mit )?x11 licen[cs]e"),
    ("isc", NOTICE, "permission to use copy modify and or distribute", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("isc", NAMED, "isc licen", "isc licen[cs]e"),
    ("0bsd", NAMED, "zero clause bsd", "(?:bsd )?zero clause bsd(?: licen[cs]e)?"),
    ("bsd-2-clause", NOTICE, "redistribution and use in source and binary forms", "redistribution and use in source and binary forms with or without modification are permitted"),
    ("bsd-3-clause", NOTICE, "endorse or promote products", "may be used to endorse or promote products derived from this software without specific prior written permission"),
    ("bsd-4-clause", NOTICE, "all advertising materials", "all advertising materials mentioning features or use of this software must display the following acknowledgement"),
    ("bsd-2-clause", VERSIONED, "bsd", "(?:2 clause|simplified|freebsd) bsd(?: licen[cs]e)?|bsd 2 clause(?: licen[cs]e)?"),
    ("bsd-3-clause", VERSIONED, "bsd", "(?:3 clause|new|modified|revised) bsd(?: licen[cs]e)?|bsd 3 clause(?: licen[cs]e)?"),
    ("bsd-4-clause", VERSIONED, "bsd", "(?:4 clause|original|old) bsd(?: licen[cs]e)?|bsd 4 clause(?: licen[cs]e)?"),
    ("bsd", NAMED, "bsd", "bsd(?: style| type)? licen[cs]e"),
    ("apache-2.0", NOTICE, "apache license", "licensed under the apache license version 2 0(?: the license)?(?: you may not use this file except in compliance with the license)?"),
    ("apache-2.0", VERSIONED, "apache", "apache(?: software)?(?: public)? licen[cs]e" + V2),
    ("apache-2.0", VERSIONED, "apache org licenses", "apache org licenses license 2 0"),
    ("apache-1.1", VERSIONED, "apache", "apache(?: software)? licen[cs]e(?: version| v)? 1 1"),
    ("apache-1.0", VERSIONED, "apache", "apache(?: software)? licen[cs]e(?: version| v)? 1 0"),
    ("apache", NAMED, "apache", "apache(?: software)?(?: public)? licen[cs]e"),
    ("zlib", NOTICE, "provided as is without any express", "this software is provided as is without any express or implied warranty in no event will the authors be held liable"),
    ("zlib", NAMED, "zlib", "zlib(?: libpng)? licen[cs]e"),
    ("libpng", NAMED, "libpng", "libpng licen[cs]e"),
    ("bsl-1.0", NOTICE, "boost software", "boost software licen[cs]e(?: version)? 1 0"),
    ("bsl-1.0", NAMED, "boost", "boost(?: software)? licen[cs]e"),
    ("unlicense", NOTICE, "free and unencumbered", "this is free and unencumbered software released into the public domain"),
    ("unlicense", NAMED, "unlicense", "(?:the )?unlicense(?: org)?"),
    ("wtfpl", NOTICE, "do what the", "do what the fuck you want to public licen[cs]e"),
    ("wtfpl", NAMED, "wtfpl", "wtfpl"),
    ("ncsa", NAMED, "ncsa", "(?:university of illinois )?ncsa (?:open source )?licen[cs]e"),
    ("python-2.0", NAMED, "python software foundation", "python software foundation licen[cs]e(?: version 2)?"),
    ("php-3.01", VERSIONED, "php licen", "php licen[cs]e(?: version)? 3 01"),
    ("php", NAMED, "php licen", "php licen[cs]e"),
    ("openssl", NAMED, "openssl", "openssl(?: ssleay)? licen[cs]e"),
    ("postgresql", NAMED, "postgresql licen", "postgresql licen[cs]e"),
    ("ruby", NAMED, "ruby licen", "ruby licen[cs]e"),
    ("perl", NOTICE, "same terms as perl", "under the same terms as perl(?: itself)?"),
    ("artistic-2.0", VERSIONED, "artistic licen", "artistic licen[cs]e" + V2),
    ("artistic", NAMED, "artistic licen", "(?:clarified )?artistic licen[cs]e"),
    ("afl-3.0", VERSIONED, "academic free", "academic free licen[cs]e" + V3),
    ("afl", NAMED, "academic free", "academic free licen[cs]e"),
    ("ecl-2.0", VERSIONED, "educational community", "educational community licen[cs]e" + V2),
    ("fair", NAMED, "fair licen", "the fair licen[cs]e"),
    ("curl", NAMED, "curl licen", "curl licen[cs]e"),
    ("w3c", NAMED, "w3c", "w3c (?:software )?(?:notice and )?licen[cs]e"),
    ("unicode", NAMED, "unicode licen", "unicode licen[cs]e"),
    ("ms-pl", NAMED, "microsoft public", "microsoft public licen[cs]e"),
    ("ms-rl", NAMED, "microsoft reciprocal", "microsoft reciprocal licen[cs]e"),
    ("upl-1.0", NAMED, "universal permissive", "universal permissive licen[cs]e(?: v(?:ersion)?)?(?: ?1 0)?"),
    ("beerware", NAMED, "beer", "(?:the )?beer ?ware licen[cs]e"),
    # Copyleft
    ("gpl-2.0-or-later", NOTICE, "general public license", "gnu general public license as published by the free software foundation either version 2 of the license" + LATER),
    ("gpl-3.0-or-later", NOTICE, "general public license", "gnu general public license as published by the free software foundation either version 3 of the license" + LATER),
    ("gpl-2.0", NOTICE, "general public license", "gnu general public license(?: version 2)? as published by the free software foundation version 2"),
    ("lgpl-2.1-or-later", NOTICE, "lesser general public license", "gnu lesser general public license as published by the free software foundation either version 2 1 of the license" + LATER),
    ("lgpl-3.0-or-later", NOTICE, "lesser general public license", "gnu lesser general public license as published by the free software foundation either version 3 of the license" + LATER),
    ("agpl-3.0-or-later", NOTICE, "affero general public license", "gnu affero general public license as published by the free software foundation either version 3 of the license" + LATER),
    ("gpl-3.0", NOTICE, "general public license", "(?:this (?:work|program|software|document) is )?(?:licensed|released|distributed) under (?:the terms of )?(?:the )?gnu general public license version 3"),
    ("gpl-2.0", NOTICE, "general public license", "(?:this (?:work|program|software|document) is )?(?:licensed|released|distributed) under (?:the terms of )?(?:the )?gnu general public license version 2"),
    ("gpl-2.0", VERSIONED, "general public licen", "(?:gnu )?general public licen[cs]e" + V2),
    ("gpl-3.0", VERSIONED, "general public licen", "(?:gnu )?general public licen[cs]e" + V3),
    ("gpl-1.0", VERSIONED, "general public licen", "(?:gnu )?general public licen[cs]e(?: version| v) 1"),
    ("gpl-2.0", VERSIONED, "gpl", "(?:gnu )?gpl ?(?:version |v )?2(?: 0)?"),
    ("gpl-3.0", VERSIONED, "gpl", "(?:gnu )?gpl ?(?:version |v )?3(?: 0)?"),
    ("gpl-2.0", VERSIONED, "gplv2", "(?:gnu )?gplv2"),
    ("gpl-3.0", VERSIONED, "gplv3", "(?:gnu )?gplv3"),
    ("lgpl-2.0", VERSIONED, "library general public", "(?:gnu )?library general public licen[cs]e(?:(?: version| v)? 2(?: 0)?)?"),
    ("lgpl-2.1", VERSIONED, "lesser general public", "(?:gnu )?lesser general public licen[cs]e(?: version| v)? 2 1"),
    ("lgpl-3.0", VERSIONED, "lesser general public", "(?:gnu )?lesser general public licen[cs]e" + V3),
    ("lgpl-2.1", VERSIONED, "lgpl", "(?:gnu )?lgpl ?(?:version |v )?2 1|lgplv2 1"),
    ("lgpl-3.0", VERSIONED, "lgpl", "(?:gnu )?lgpl ?(?:version |v )?3(?: 0)?|lgplv3"),
    ("agpl-3.0", VERSIONED, "affero general public", "(?:gnu )?affero general public licen[cs]e" + V3),
    ("agpl-3.0", VERSIONED, "agpl", "(?:gnu )?agpl ?(?:version |v )?3(?: 0)?|agplv3"),
    ("gpl", NAMED, "general public licen", "(?:gnu )?general public licen[cs]e"),
    ("lgpl", NAMED, "general public licen", "(?:gnu )?(?:lesser|library) general public licen[cs]e"),
    ("agpl", NAMED, "affero", "(?:gnu )?affero general public licen[cs]e"),
    ("gpl", NAMED, "gnu gpl", "gnu gpl"),
    ("lgpl", NAMED, "gnu lgpl", "gnu lgpl"),
    ("gfdl", NOTICE, "free documentation licen", "permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation licen[cs]e"),
    ("gfdl-1.3", VERSIONED, "free documentation licen", "(?:gnu )?free documentation licen[cs]e(?: version| v)? 1 3"),
    ("gfdl-1.2", VERSIONED, "free documentation licen", "(?:gnu )?free documentation licen[cs]e(?: version| v)? 1 2"),
    ("gfdl", NAMED, "free documentation licen", "(?:gnu )?free documentation licen[cs]e"),
    ("mpl-2.0", NOTICE, "mozilla public", "this source code form is subject to the terms of the mozilla public licen[cs]e v 2 0"),
    ("mpl-2.0", VERSIONED, "mozilla public", "mozilla public licen[cs]e" + V2),
    ("mpl-1.1", VERSIONED, "mozilla public", "mozilla public licen[cs]e(?: version| v)? 1 1"),
    ("mpl", NAMED, "mozilla public", "mozilla public licen[cs]e"),
    ("epl-2.0", VERSIONED, "eclipse public", "eclipse public licen[cs]e" + V2),
    ("epl-1.0", VERSIONED, "eclipse public", "eclipse public licen[cs]e(?: version| v)? 1 0"),
    ("epl", NAMED, "eclipse public", "eclipse public licen[cs]e"),
    ("eupl-1.2", VERSIONED, "european union public", "european union public licen[cs]e(?: version| v)? 1 2"),
    ("eupl", NAMED, "european union public", "european union public licen[cs]e"),
    ("cddl-1.0", VERSIONED, "common development and distribution", "common development and distribution licen[cs]e(?: cddl)?(?: version| v)? 1 0"),
    ("cddl", NAMED, "common development and distribution", "common development and distribution licen[cs]e"),
    ("cpl-1.0", NAMED, "common public licen", "common public licen[cs]e(?:(?: version| v)? 1 0)?"),
    ("osl-3.0", NAMED, "open software licen", "open software licen[cs]e(?:" + V3 + ")?"),
    ("cecill-2.1", VERSIONED, "cecill", "cecill(?: licen[cs]e)?(?: version| v)? 2 1"),
    ("cecill", NAMED, "cecill", "cecill(?: [bc])?(?: licen[cs]e)?"),
    ("sspl-1.0", NAMED, "server side public", "server side public licen[cs]e(?:(?: version| v)? 1(?: 0)?)?"),
    ("busl-1.1", NAMED, "business source", "business source licen[cs]e(?:(?: version| v)? 1 1)?"),
    ("elastic-2.0", NAMED, "elastic licen", "elastic licen[cs]e(?:" + V2 + ")?"),
    ("commons-clause", NAMED, "commons clause", "commons clause(?: licen[cs]e condition)?"),
    ("polyform", NAMED, "polyform", "polyform (?:noncommercial|small business|perimeter|shield|strict) licen[cs]e"),
    ("qpl-1.0", NAMED, "q public", "q public licen[cs]e"),
    ("sleepycat", NAMED, "sleepycat", "sleepycat licen[cs]e"),
    ("ibm-public", NAMED, "ibm public", "ibm public licen[cs]e"),
    ("nokia-open", NAMED, "nokia open", "nokia open source licen[cs]e"),
    # Data, content and fonts
    ("cc0-1.0", NOTICE, "waived all copyright", "has waived all copyright and related or neighboring rights"),
    ("cc0-1.0", VERSIONED, "cc0", "cc0(?: 1 0)?(?: universal)?(?: public domain dedication)?"),
    ("cc0-1.0", VERSIONED, "publicdomain zero", "creativecommons org publicdomain zero 1 0"),
    ("cc-pd", NAMED, "publicdomain mark", "creativecommons org publicdomain mark 1 0"),
    ("cc", NAMED, "creative commons", "(?:a |the )?creative commons(?: public)? licen[cs]e"),
    ("cc", GENERAL, "creative commons", "creative commons"),
    ("odbl-1.0", NAMED, "database licen", "open (?:data commons )?(?:open )?database licen[cs]e(?: v?1 0)?"),
    ("odc-by-1.0", NAMED, "open data commons attribution", "open data commons attribution licen[cs]e"),
    ("pddl-1.0", NAMED, "public domain dedication and licen", "public domain dedication and licen[cs]e"),
    ("ogl-uk", NAMED, "open government licen", "open government licen[cs]e(?: v(?:ersion)? ?[123](?: 0)?)?"),
    ("ofl-1.1", NAMED, "open font licen", "(?:sil )?open font licen[cs]e(?:(?: version| v)? 1 1)?"),
    ("free-art", NAMED, "free art licen", "free art licen[cs]e(?: 1 [23])?"),
    ("openrail", NAMED, "openrail", "(?:bigscience |creativeml )?openrail(?: m)?(?: licen[cs]e)?"),
    ("cdla-permissive", NAMED, "community data licen", "community data licen[cs]e agreement permissive"),
    ("cdla-sharing", NAMED, "community data licen", "community data licen[cs]e agreement sharing"),
    ("public-domain", NOTICE, "public domain", "(?:this (?:work|text|software|file) is|released|placed|dedicated) (?:in|in to|into|to) the public domain"),
    ("public-domain", GENERAL, "public domain", "public domain"),
    # Rights kept
    ("reserved", NAMED, "all rights reserved", "all rights reserved"),
    ("reserved", NAMED, "tous droits", "tous droits réservés"),
    ("reserved", NAMED, "alle rechte", "alle rechte vorbehalten"),
    ("reserved", NAMED, "derechos reservados", "todos los derechos reservados"),
    ("reserved", NAMED, "diritti riservati", "tutti i diritti riservati"),
    ("reserved", NAMED, "direitos reservados", "todos os direitos reservados"),
    ("reserved", NAMED, "rechten voorbehouden", "alle rechten voorbehouden"),
    ("reserved", NOTICE, "no part of this", "no part of this (?:publication|book|work|document) may be reproduced"),
    ("proprietary", NOTICE, "confidential and proprietary", "(?:is |are )?confidential and proprietary"),
    ("proprietary", NOTICE, "is strictly prohibited", "unauthori[sz]ed copying of this (?:file|software|document|work) ... is strictly prohibited"),
    ("proprietary", NAMED, "end user licen", "end user licen[cs]e agreement"),
    ("non-commercial", NAMED, "commercial use", "(?:for )?non ?commercial use only|no commercial use"),
    ("academic-only", NAMED, "use only", "for (?:academic|research)(?: and (?:academic|research))? use only"),
    ("academic-only", NAMED, "purposes only", "for (?:academic|research)(?: and (?:academic|research))? purposes only"),
    ("copyright", GENERAL, "copyright", "copyright (?:c )?(?:19|20)[0-9]{2}(?: (?:19|20)[0-9]{2})?"),
    ("copyright", GENERAL, "copyright", "copyright (?:c|by|holders?|notice)"),
    # Said in general
    ("licensed", GENERAL, "licensed under", "(?:is |are )?(?:dual )?licensed under"),
    ("licensed", GENERAL, "released under", "(?:is |are )?released under (?:the|a) ... licen[cs]e"),
    ("licensed", GENERAL, "subject to the terms", "subject to the terms (?:and conditions )?of ... licen[cs]e"),
    ("licensed", GENERAL, "see the licen", "see the licen[cs]e(?: file)? for(?: the)?(?: more)? (?:details|specific language governing permissions)"),
    ("licensed", GENERAL, "licence", "sous (?:la )?licence"),
    ("licensed", GENERAL, "lizenz", "(?:unter|unterliegt) der ... lizenz"),
    ("licensed", GENERAL, "bajo", "bajo (?:la |una )?licencia"),
]

#: Identifiers of the tag ``SPDX-License-Identifier``, also after ``License:``.
TAGS = """
    MIT MIT-0 X11 ISC 0BSD BSD-2-Clause BSD-3-Clause BSD-4-Clause Apache-1.0 Apache-1.1 Apache-2.0 Zlib Libpng BSL-1.0 Unlicense WTFPL NCSA
    Python-2.0 PHP-3.01 OpenSSL PostgreSQL Ruby Artistic-2.0 AFL-3.0 ECL-2.0 Fair curl W3C MS-PL MS-RL UPL-1.0 Beerware
    GPL-1.0-only GPL-2.0 GPL-2.0-only GPL-2.0-or-later GPL-3.0 GPL-3.0-only GPL-3.0-or-later LGPL-2.0-only LGPL-2.1 LGPL-2.1-only
    LGPL-2.1-or-later LGPL-3.0 LGPL-3.0-only LGPL-3.0-or-later AGPL-3.0 AGPL-3.0-only AGPL-3.0-or-later GFDL-1.2 GFDL-1.3
    MPL-1.1 MPL-2.0 EPL-1.0 EPL-2.0 EUPL-1.2 CDDL-1.0 CPL-1.0 OSL-3.0 CECILL-2.1 SSPL-1.0 BUSL-1.1 Elastic-2.0 QPL-1.0 Sleepycat
    CC0-1.0 ODbL-1.0 ODC-By-1.0 PDDL-1.0 OFL-1.1
""".split()
CC_KINDS = ["by", "by-sa", "by-nd", "by-nc", "by-nc-sa", "by-nc-nd"]
CC_VERSIONS = ["1.0", "2.0", "2.5", "3.0", "4.0"]
CC_NAMES = {"by": "attribution", "sa": "share ?alike", "nd": "no ?deriv(?:ative)?s(?: works)?", "nc": "non ?commercial"}


class Rule(NamedTuple):
    name: str
    label: str
    priority: int
    keyword: str
    pattern: str


def words(name: str) -> str:
    """A name as normalised text."""
    return " ".join(re.findall("[a-z0-9]+", name.lower()))


def _tags() -> list[tuple[str, int, str, str]]:
    creative = [f"CC-{kind.upper()}-{version}" for kind, version in itertools.product(CC_KINDS, CC_VERSIONS)]
    rows = []
    for tag in [*TAGS, *creative]:
        rows.append((tag.lower(), TAG, "spdx license identifier", f"spdx license identifier {words(tag)}"))
        rows.append((tag.lower(), VERSIONED, f"license {words(tag)}", f"license {words(tag)}"))
    return rows


def _creative_commons() -> list[tuple[str, int, str, str]]:
    rows = []
    for kind in CC_KINDS:
        spoken = " ".join(CC_NAMES[part] for part in kind.split("-"))
        for version in CC_VERSIONS:
            rows.append((f"cc-{kind}-{version}", NOTICE, f"cc {words(kind)}", f"licensed under cc {words(kind)} {words(version)}"))
            rows.append((f"cc-{kind}-{version}", VERSIONED, f"cc {words(kind)}", f"cc {words(kind)} {words(version)}"))
            rows.append((f"cc-{kind}-{version}", VERSIONED, "creativecommons org", f"creativecommons org licenses {words(kind)} {words(version)}"))
            rows.append((f"cc-{kind}-{version}", VERSIONED, "creative commons", f"creative commons {spoken}(?: {words(version)} (?:international|unported|generic)| (?:international |unported |generic )?(?:public )?(?:licen[cs]e )?{words(version)})"))
        rows.append((f"cc-{kind}", NAMED, f"cc {words(kind)}", f"cc {words(kind)}"))
        rows.append((f"cc-{kind}", NAMED, "creative commons", f"creative commons {spoken}"))
    return rows


def rules() -> list[Rule]:
    """All rules; among equal ones the earlier one counts."""
    rows = [*WRITTEN, *_tags(), *_creative_commons()]
    return [
        Rule(f"{label}#{n}", label, priority, keyword, pattern.replace(f" {GAP} ", r"(?: \S+){0,8}? ")) for n, (label, priority, keyword, pattern) in enumerate(rows)
    ]
