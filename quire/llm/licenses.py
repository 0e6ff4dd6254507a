"""License scans by sentence rules.

A text is cut into sentences, each is normalised, and known licence sentences become identifiers (a sentence
that isn't known gives way to its lines, so a licence line without a full stop before it is found too). The
sequence of identifiers is then matched against ordered rules: longer and more specific sequences come first and use
up the identifiers that they match. At most GAP unknown sentences may lie between two of a rule's identifiers, so parts that are far apart aren't taken for one licence.

DataFrame expressions only, narrow: one pass over the text, no shuffle, so neither skew nor copies matter. The
sentence table is a literal map in the plan. Every known sentence has one of a few words (``anchors``), so texts without any of them are cut and counted, but not looked up.

Sentences that name somebody, as the clauses of BSD licences do, are known by patterns with a hole for the name (CLAUSES). Two names of licences after "licensed under" are a choice of both, and SPDX tags are read as
expressions, with AND, OR, WITH, parentheses and the older "+"; both are identifiers that say their licence. A clause with a number that isn't known is no gap: no rule reaches over it, and a BSD licence that goes
on with one is told as ``LicenseRef-BSD``, not as the shorter BSD-2-Clause.

Defined results: null and empty texts have no sentences and give empty strings; a null key passes through; a text of any length is scanned whole; where several
rules match at one place, the first of them takes it; repeated rows give repeated results; other columns are ignored, whatever their names; an empty table gives no rows.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Sentences of public licence texts, as they are after normalisation, by identifier.
SENTENCES = {
    "ApacheShort": "licensed under the apache license version 2 0",
    "ApacheHead": "licensed under the apache license version 2 0 the license",
    "ApacheUse": "you may not use this file except in compliance with the license",
    "ApacheCopyAt": "you may obtain a copy of the license at",
    "ApacheCopyUrl": "you may obtain a copy of the license at http www apache org licenses license 2 0",
    "ApacheUrl": "http www apache org licenses license 2 0",
    "ApacheBasis": "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied",
    "ApacheSee": "see the license for the specific language governing permissions and limitations under the license",
    "MitShort": "released under the mit license",
    "MitLicensed": "licensed under the mit license",
    "MitTitle": "mit license",
    "MitTitleThe": "the mit license",
    "MitGrant": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions",
    "MitNotice": "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
    "MitAsIs": "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement",
    "MitLiable": "in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software",
    "BsdGrant": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    "BsdSource": "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer",
    "BsdBinary": "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution",
    "BsdEndorse": "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    "BsdAsIs": "this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed",
    "BsdShort2": "licensed under the bsd 2 clause license",
    "BsdShort3": "licensed under the bsd 3 clause license",
    "IscGrant": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",
    "FreeProgram": "this program is free software",
    "FreeLibrary": "this library is free software",
    "Gpl2Later": "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version",
    "Gpl3Later": "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "Lgpl21Later": "you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 2 1 of the license or at your option any later version",
    "Lgpl3Later": "you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "GplHope": "this program is distributed in the hope that it will be useful but without any warranty",
    "LgplHope": "this library is distributed in the hope that it will be useful but without any warranty",
    "GplImplied": "without even the implied warranty of merchantability or fitness for a particular purpose",
    "GplSee": "see the gnu general public license for more details",
    "LgplSee": "see the gnu lesser general public license for more details",
    "GplCopy": "you should have received a copy of the gnu general public license along with this program",
    "LgplCopy": "you should have received a copy of the gnu lesser general public license along with this library",
    "Gpl2Short": "this work is licensed under the gnu general public license version 2",
    "Gpl3Short": "this work is licensed under the gnu general public license version 3",
    "Gpl2Licensed": "licensed under the gnu general public license version 2",
    "Gpl3Licensed": "licensed under the gnu general public license version 3",
    "MplSubject": "this source code form is subject to the terms of the mozilla public license v 2 0",
    "MplCopy": "if a copy of the mpl was not distributed with this file you can obtain one at http mozilla org mpl 2 0",
    "Unlicense": "this is free and unencumbered software released into the public domain",
    "Cc0Short": "licensed under cc0 1 0",
    "CcByShort": "licensed under cc by 4 0",
    "CcBySaShort": "licensed under cc by sa 4 0",
    "CcByNcShort": "licensed under cc by nc 4 0",
    "CcByNdShort": "licensed under cc by nd 4 0",
    "CcByNcSaShort": "licensed under cc by nc sa 4 0",
    "CcByLong": "this work is licensed under a creative commons attribution 4 0 international license",
    "CcBySaLong": "this work is licensed under a creative commons attribution sharealike 4 0 international license",
    "CcByNcLong": "this work is licensed under a creative commons attribution noncommercial 4 0 international license",
    "SpdxApache": "spdx license identifier apache 2 0",
    "SpdxMit": "spdx license identifier mit",
    "SpdxBsd2": "spdx license identifier bsd 2 clause",
    "SpdxBsd3": "spdx license identifier bsd 3 clause",
    "SpdxGpl2": "spdx license identifier gpl 2 0 only",
    "SpdxGpl3": "spdx license identifier gpl 3 0 only",
    "SpdxMpl2": "spdx license identifier mpl 2 0",
}

#: In order: a licence and the identifiers that make it, ``?`` after those that may be missing, ``|`` between alternatives.
RULES = (
    ("Apache-2.0", "ApacheHead ApacheUse? ApacheCopyAt|ApacheCopyUrl? ApacheUrl? ApacheBasis? ApacheSee?"),
    ("BSD-3-Clause", "Copyright? BsdGrant BsdSource BsdBinary BsdEndorse BsdAsIs? BsdLiable?"),
    ("LicenseRef-BSD", "Copyright? BsdGrant BsdSource BsdBinary % BsdAsIs? BsdLiable?"),
    ("BSD-2-Clause", "Copyright? BsdGrant BsdSource BsdBinary BsdAsIs? BsdLiable?"),
    ("MIT", "MitTitle|MitTitleThe? Copyright? MitGrant MitNotice? MitAsIs? MitLiable?"),
    ("ISC", "Copyright? IscGrant"),
    ("LGPL-2.1-or-later", "FreeLibrary|FreeProgram? Lgpl21Later LgplHope|GplHope? GplImplied? LgplSee? LgplCopy?"),
    ("LGPL-3.0-or-later", "FreeLibrary|FreeProgram? Lgpl3Later LgplHope|GplHope? GplImplied? LgplSee? LgplCopy?"),
    ("GPL-2.0-or-later", "FreeProgram? Gpl2Later GplHope? GplImplied? GplSee? GplCopy?"),
    ("GPL-3.0-or-later", "FreeProgram? Gpl3Later GplHope? GplImplied? GplSee? GplCopy?"),
    ("MPL-2.0", "MplSubject MplCopy?"),
    ("Unlicense", "Unlicense"),
    ("Apache-2.0", "ApacheShort|SpdxApache|ApacheUrl"),
    ("MIT", "MitShort|MitLicensed|SpdxMit"),
    ("GPL-2.0-only", "Gpl2Short|Gpl2Licensed|SpdxGpl2"),
    ("GPL-3.0-only", "Gpl3Short|Gpl3Licensed|SpdxGpl3"),
    ("BSD-2-Clause", "BsdShort2|SpdxBsd2"),
    ("BSD-3-Clause", "BsdShort3|SpdxBsd3"),
    ("MPL-2.0", "SpdxMpl2"),
    ("CC0-1.0", "Cc0Short"),
    ("CC-BY-4.0", "CcByShort|CcByLong"),
    ("CC-BY-SA-4.0", "CcBySaShort|CcBySaLong"),
    ("CC-BY-NC-4.0", "CcByNcShort|CcByNcLong"),
    ("CC-BY-ND-4.0", "CcByNdShort"),
    ("CC-BY-NC-SA-4.0", "CcByNcSaShort"),
)

#: Beside those of the SQL: the Affero GPL, and identifiers of every licence that has a rule.
MORE_SENTENCES = {
    "Agpl3Later": "you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "AgplSee": "see the gnu affero general public license for more details",
    "AgplCopy": "you should have received a copy of the gnu affero general public license along with this program",
    "Agpl3Short": "this work is licensed under the gnu affero general public license version 3",
    "Agpl3Licensed": "licensed under the gnu affero general public license version 3",
    "MplCopyHttps": "if a copy of the mpl was not distributed with this file you can obtain one at https mozilla org mpl 2 0",
    "SpdxIsc": "spdx license identifier isc",
    "SpdxUnlicense": "spdx license identifier unlicense",
    "SpdxGpl2Later": "spdx license identifier gpl 2 0 or later",
    "SpdxGpl3Later": "spdx license identifier gpl 3 0 or later",
    "SpdxLgpl21Later": "spdx license identifier lgpl 2 1 or later",
    "SpdxLgpl3Later": "spdx license identifier lgpl 3 0 or later",
    "SpdxAgpl3": "spdx license identifier agpl 3 0 only",
    "SpdxAgpl3Later": "spdx license identifier agpl 3 0 or later",
    "SpdxCc0": "spdx license identifier cc0 1 0",
    "SpdxCcBy": "spdx license identifier cc by 4 0",
    "SpdxCcBySa": "spdx license identifier cc by sa 4 0",
    "SpdxCcByNc": "spdx license identifier cc by nc 4 0",
    "SpdxCcByNd": "spdx license identifier cc by nd 4 0",
    "SpdxCcByNcSa": "spdx license identifier cc by nc sa 4 0",
    "Epl2Made": "this program and the accompanying materials are made available under the terms of the eclipse public license 2 0 which is available at https www eclipse org legal epl 2 0",
    "ZlibAsIs": "this software is provided as is without any express or implied warranty",
    "ZlibLiable": "in no event will the authors be held liable for any damages arising from the use of this software",
    "ZlibGrant": "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions",
    "ZeroBsdGrant": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted",
    "BoostGrant": "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license the software to use reproduce display distribute execute and transmit the software and to prepare derivative works of the software and to permit third parties to whom the software is furnished to do so all subject to the following",
    "ArtisticShort": "licensed under the artistic license 2 0",
    "ApacheBody": "apache license version 2 0 january 2004 http www apache org licenses",
    "Gpl2Body": "gnu general public license version 2 june 1991",
    "Gpl3Body": "gnu general public license version 3 29 june 2007",
    "Lgpl21Body": "gnu lesser general public license version 2 1 february 1999",
    "Lgpl3Body": "gnu lesser general public license version 3 29 june 2007",
    "Agpl3Body": "gnu affero general public license version 3 19 november 2007",
    "MplBody": "mozilla public license version 2 0",
    "EplBody": "eclipse public license v 2 0",
    "ArtisticBody": "the artistic license 2 0",
    "SpdxEpl": "spdx license identifier epl 2 0",
    "SpdxZlib": "spdx license identifier zlib",
    "SpdxZeroBsd": "spdx license identifier 0bsd",
    "SpdxBoost": "spdx license identifier bsl 1 0",
    "SpdxArtistic": "spdx license identifier artistic 2 0",
    "SpdxLgpl21": "spdx license identifier lgpl 2 1 only",
    "SpdxLgpl3": "spdx license identifier lgpl 3 0 only",
    "Gpl2Only": "you can redistribute it and or modify it under the terms of the gnu general public license version 2 as published by the free software foundation",
    "Gpl2OnlyOf": "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation version 2 of the license",
    "Gpl2OnlyWord": "you can redistribute it and or modify it under the terms of the gnu general public license version 2 only as published by the free software foundation",
    "Gpl3Only": "you can redistribute it and or modify it under the terms of the gnu general public license version 3 as published by the free software foundation",
    "Gpl3OnlyOf": "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation version 3 of the license",
    "Lgpl21Only": "you can redistribute it and or modify it under the terms of the gnu lesser general public license version 2 1 as published by the free software foundation",
    "Lgpl21OnlyOf": "you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation version 2 1 of the license",
    "Lgpl3Only": "you can redistribute it and or modify it under the terms of the gnu lesser general public license version 3 as published by the free software foundation",
    "Lgpl3OnlyOf": "you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation version 3 of the license",
    "Agpl3Only": "you can redistribute it and or modify it under the terms of the gnu affero general public license version 3 as published by the free software foundation",
    "BsdAdvert": "all advertising materials mentioning features or use of this software must display the following acknowledgement",
}

#: These come before RULES.
MORE_RULES = (
    ("AGPL-3.0-or-later", "FreeProgram? Agpl3Later GplHope? GplImplied? AgplSee? AgplCopy?"),
    ("MPL-2.0", "MplSubject MplCopyHttps"),
    ("BSD-4-Clause", "Copyright? BsdGrant BsdSource BsdBinary BsdAdvert BsdCredit? BsdEndorse BsdAsIs? BsdLiable?"),
    ("GPL-2.0-only", "FreeProgram? Gpl2Only|Gpl2OnlyOf|Gpl2OnlyWord GplHope? GplImplied? GplSee? GplCopy?"),
    ("GPL-3.0-only", "FreeProgram? Gpl3Only|Gpl3OnlyOf GplHope? GplImplied? GplSee? GplCopy?"),
    ("LGPL-2.1-only", "FreeLibrary|FreeProgram? Lgpl21Only|Lgpl21OnlyOf LgplHope|GplHope? GplImplied? LgplSee? LgplCopy?"),
    ("LGPL-3.0-only", "FreeLibrary|FreeProgram? Lgpl3Only|Lgpl3OnlyOf LgplHope|GplHope? GplImplied? LgplSee? LgplCopy?"),
    ("AGPL-3.0-only", "FreeProgram? Agpl3Only GplHope? GplImplied? AgplSee? AgplCopy?"),
    ("AGPL-3.0-or-later", "SpdxAgpl3Later"),
    ("AGPL-3.0-only", "Agpl3Short|Agpl3Licensed|SpdxAgpl3"),
    ("ISC", "SpdxIsc"),
    ("Unlicense", "SpdxUnlicense"),
    ("GPL-2.0-or-later", "SpdxGpl2Later"),
    ("GPL-3.0-or-later", "SpdxGpl3Later"),
    ("LGPL-2.1-or-later", "SpdxLgpl21Later"),
    ("LGPL-3.0-or-later", "SpdxLgpl3Later"),
    ("CC0-1.0", "SpdxCc0"),
    ("CC-BY-4.0", "SpdxCcBy"),
    ("CC-BY-SA-4.0", "SpdxCcBySa"),
    ("CC-BY-NC-4.0", "SpdxCcByNc"),
    ("CC-BY-ND-4.0", "SpdxCcByNd"),
    ("CC-BY-NC-SA-4.0", "SpdxCcByNcSa"),
    ("Zlib", "Copyright? ZlibAsIs? ZlibLiable? ZlibGrant"),
    ("0BSD", "Copyright? ZeroBsdGrant"),
    ("BSL-1.0", "BoostGrant"),
    ("EPL-2.0", "Epl2Made SpdxEpl?"),
    ("EPL-2.0", "EplBody|SpdxEpl"),
    ("Zlib", "SpdxZlib"),
    ("0BSD", "SpdxZeroBsd"),
    ("BSL-1.0", "SpdxBoost"),
    ("Artistic-2.0", "ArtisticShort|ArtisticBody|SpdxArtistic"),
    ("Apache-2.0", "ApacheBody"),
    ("GPL-2.0-only", "Gpl2Body"),
    ("GPL-3.0-only", "Gpl3Body"),
    ("LGPL-2.1-only", "Lgpl21Body|SpdxLgpl21"),
    ("LGPL-3.0-only", "Lgpl3Body|SpdxLgpl3"),
    ("AGPL-3.0-only", "Agpl3Body"),
    ("MPL-2.0", "MplBody"),
)

#: Clauses that name somebody: an identifier, words that a sentence must have, and its pattern after normalisation. The patterns here and below are of the kind that both Java and DuckDB take.
CLAUSES = (
    ("BsdEndorse", "endorse or promote products derived from this software", "^(?:[0-9]{1,2} )?(?:neither )?(?:the )?names? .* endorse or promote products derived from this software(?: .*)?$"),
    ("BsdAsIs", "any express or implied warranties including but not limited to the implied warranties", "^this software is provided by .* as is and any express or implied warranties including but not limited to the implied warranties .* disclaimed$"),
    ("BsdLiable", "be liable for any direct indirect incidental special exemplary or consequential damages", "^in no event shall .* be liable for any direct indirect incidental special exemplary or consequential damages(?: .*)?$"),
    ("BsdCredit", "this product includes software developed by", "^this product includes software developed by .*$"),
)

#: What licences are called where a text is licensed under one or another.
NAMES = {
    "mit license": "MIT", "mit": "MIT", "apache license version 2 0": "Apache-2.0", "apache license 2 0": "Apache-2.0", "apache 2 0 license": "Apache-2.0", "apache 2 0": "Apache-2.0",
    "bsd 2 clause license": "BSD-2-Clause", "bsd 3 clause license": "BSD-3-Clause", "isc license": "ISC", "mozilla public license version 2 0": "MPL-2.0", "mpl 2 0": "MPL-2.0", "unlicense": "Unlicense",
    "gnu general public license version 2": "GPL-2.0-only", "gpl version 2": "GPL-2.0-only", "gpl v2": "GPL-2.0-only", "gnu general public license version 3": "GPL-3.0-only", "gpl version 3": "GPL-3.0-only", "gpl v3": "GPL-3.0-only",
    "gnu lesser general public license version 2 1": "LGPL-2.1-only", "gnu lesser general public license version 3": "LGPL-3.0-only", "boost software license 1 0": "BSL-1.0", "zlib license": "Zlib", "cc0 1 0": "CC0-1.0",
}
_ANY = "|".join(sorted(NAMES, key=len, reverse=True))
EITHER = f"^(?:.* )?licensed under (?:the )?(?:terms of )?(?:either |both )?(?:of )?(?:the )?({_ANY}) (?:and|or) (?:the )?({_ANY})(?: .*)?$"

#: An SPDX tag's expression in a line.
SPDX = r"(?i:spdx-license-identifier)[.!?;:]*[\x01\x20\x09]*((?:\(+[\x20\x09]*)?[A-Za-z0-9][A-Za-z0-9.+:-]*\)*(?:[\x20\x09]+(?:AND|OR|WITH)[\x20\x09]+\(*[A-Za-z0-9][A-Za-z0-9.+:-]*\)*)*)"
#: Older names of the GNU licences in it, and what they are called now.
OLDER = ((r"((?:^|[^A-Za-z-])[AL]?GPL-[0-9.]+)\+", "{1}-or-later"), (r"((?:^|[^A-Za-z-])[AL]?GPL-[0-9]\.[0-9])($|[\x20)])", "{1}-only{2}"))

#: Unknown sentences that may lie between two identifiers of a rule (a number before a clause is one).
GAP = 4

#: Marks that end no sentence: that after an SPDX tag, that of "v. 2.0", that of an initial, a semicolon before "version", and what ends a name inside of a clause. (Initials
#: are looked for twice, as white space between two of them is taken by the first.) They become a mark of their own before texts are cut.
SPARED = (
    (r"((?i:spdx-license-identifier))[.!?;:]+", "{1}\x01"),
    (r"(^|[^A-Za-z0-9])([Vv])\.([\x20\x09-\x0D]+[0-9])", "{1}{2}\x01{3}"),
    *((r"(^|[\x20\x09-\x0D(])([A-Z])\.([\x20\x09-\x0D]+)", "{1}{2}\x01{3}"),) * 2,
    (r";([^A-Za-z0-9]{1,80}(?i:(?:either[^A-Za-z0-9]{1,80})?version))", "\x01{1}"),
    (r"[.,]+([^A-Za-z0-9]{1,80}(?i:nor[^A-Za-z0-9]|(?:and|or)[^A-Za-z0-9]{1,80}contributors|be[^A-Za-z0-9]{1,80}liable|may[^A-Za-z0-9]{1,80}not[^A-Za-z0-9]{1,80}be[^A-Za-z0-9]{1,80}used))", "\x01{1}"),
)
#: A sentence ends at a mark before white space, or at a line that is empty but for comment marks.
CUTS = r"[.!?;:]+[\x20\x09-\x0D]+|\n[\x20\x09-\x0D#*/;%-]*\n"

#: In lower case: the word where it doesn't begin a notice, and notices: copyright lines in a row, with the years and the reservation that may follow; not text that is wrapped before the word.
NO_NOTICE = (r"copyright([^a-z0-9\n]+(?:notice|holder|owner|law|and|or|in)s?(?:[^a-z0-9]|$))", "copyri\x02ht{1}")
_NOTICE = r"[^a-z0-9\n]*copyright[^a-z0-9\n]+[a-z0-9][^\n]*"
NOTICES = rf"(?m)^{_NOTICE}$(?:\n(?:{_NOTICE}|[^a-z0-9\n]*(?:[12][0-9]{{3}}(?:[^0-9\n][^\n]*)?|all rights reserved[^\n]*))$)*"

#: An unknown sentence is written ``~``, one that is a number alone ``#``, and a clause with a number ``%``.
NUMBER = "^[0-9]{1,2}$"
NUMBERED = r"^[^A-Za-z0-9]*\(?[0-9]{1,2}\)"


def pattern(rule: str) -> str:
    """The rule over a sequence written ``<A>~<B>`` as a regular expression."""
    out, begun, gap = [], False, f"[~#]{{0,{GAP}}}"
    for part in rule.split():
        names = "%" if part == "%" else "(?:" + "|".join(f"<{n}>" for n in part.rstrip("?").split("|")) + ")"
        if part.endswith("?"):
            out.append(f"(?:{gap}{names})?" if begun else f"(?:{names}{gap})?")
        else:
            out.append(gap + names if begun else names)
            begun = True
    return "".join(out)


def anchors(table: dict[str, str]) -> list[str]:
    """Words of which every known sentence, clause, choice, expression and copyright line has one."""
    left, out = {frozenset(s.split()) for s in (*table.values(), *(words for _, words, _ in CLAUSES))}, ["copyright", "licensed", "spdx"]
    while left := {s for s in left if not s & set(out)}:
        words = sorted({w for s in left for w in s if len(w) > 4} or {w for s in left for w in s})
        out.append(max(words, key=lambda w: sum(w in s for s in left)))
    return out


def _normal(s: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(s), "[^a-z0-9]+", " "))


def _replaced(s: Column, how: tuple[str, str]) -> Column:
    return F.regexp_replace(s, how[0], re.sub(r"\{(\d)\}", r"$\1", how[1]))


def scan(docs: DataFrame, key: str = "doc_id", text: str = "text", sentences: dict[str, str] | None = None, rules=MORE_RULES + RULES) -> DataFrame:
    """``key``, ``n_sentences``, ``n_known``, ``sentence_ids`` in order, ``licenses`` in order, and ``unmatched_ids`` that no rule used."""
    table = sentences or SENTENCES | MORE_SENTENCES
    known = F.create_map(*[F.lit(x) for name, s in table.items() for x in (s, name)])
    called = F.create_map(*[F.lit(x) for pair in NAMES.items() for x in pair])
    # A one-element array binds what is looked up to a variable, so it is evaluated once.
    first = lambda value, then: F.element_at(F.transform(F.array(value), then), 1)

    def by_pattern(n: Column) -> Column:
        out = F.lit(None).cast("string")
        for name, words, clause in CLAUSES:
            out = F.when(F.contains(n, F.lit(words)) & F.regexp_like(n, F.lit(clause)), name).otherwise(out)
        name = lambda k: F.element_at(called, F.regexp_extract(n, EITHER, k))
        return F.when(F.contains(n, F.lit("licensed under")) & F.regexp_like(n, F.lit(EITHER)), F.concat(F.lit("Either:"), name(1), F.lit(" OR "), name(2))).otherwise(out)

    def expression(line: Column) -> Column:
        said = F.trim(F.regexp_replace(F.regexp_extract(line, SPDX, 1), r"[\x20\x09]+", " "))
        for how in OLDER:
            said = _replaced(said, how)
        return F.when(said != "", F.concat(F.lit("Spdx:"), said))

    def found_in(part: Column, otherwise) -> Column:
        return first(_normal(part), lambda n: first(F.coalesce(F.try_element_at(known, n), by_pattern(n)), lambda found: F.when(found.isNotNull(), F.array(found)).otherwise(otherwise(part))))

    def by_line(part: Column) -> Column:
        def one(line: Column) -> Column:
            own = first(_normal(line), lambda n: F.when(n.startswith("copyright "), F.lit("Copyright")).otherwise(F.coalesce(F.try_element_at(known, n), by_pattern(n))))
            return F.coalesce(own, F.when(F.contains(F.lower(line), F.lit("spdx-license-identifier")), expression(line)))

        return F.filter(F.transform(F.split(part, "\n"), one), lambda x: x.isNotNull())

    def around_notices(sentence: Column) -> Column:
        # No sentence has an empty line, so it separates; the notice itself becomes one line. Java keeps no place to come back to for each line of a notice of any length if its loop is possessive.
        cut = F.split(F.regexp_replace(_replaced(F.lower(sentence), NO_NOTICE), NOTICES + "+", "\n\ncopyright notice\n\n"), "\n\n")
        return F.flatten(F.transform(F.transform(cut, lambda part: F.replace(part, F.lit("copyri\x02ht"), F.lit("copyright"))), lambda part: found_in(part, by_line)))

    def ids(sentence: Column) -> Column:
        rest = lambda s: F.when(F.lower(s).contains("copyright"), around_notices(s)).otherwise(by_line(s))
        return found_in(sentence, rest)

    spared = F.coalesce(F.col(text), F.lit(""))
    for how in SPARED:
        spared = _replaced(spared, how)
    parts = F.filter(F.split(spared, CUTS), lambda s: F.regexp_like(s, F.lit("[A-Za-z0-9]")))
    unknown = lambda s: F.when(F.regexp_like(_normal(s), F.lit(NUMBER)), "#").when(F.regexp_like(s, F.lit(NUMBERED)), "%").otherwise("~")
    found = docs.select(F.col(key), F.col(text).alias("t_"), parts.alias("parts_"))
    some = F.lit(False)
    for word in anchors(table):
        some = some | F.contains(F.lower("t_"), F.lit(word))
    each = F.flatten(F.transform("parts_", lambda s: first(ids(s), lambda x: F.when(F.size(x) > 0, x).otherwise(F.array(unknown(s))))))
    found = found.select(key, F.size("parts_").cast("long").alias("n_sentences"), F.when(some, each).otherwise(F.array().cast("array<string>")).alias("all_"))
    found = found.select(key, "n_sentences", "all_", F.filter("all_", lambda i: ~i.isin("~", "#", "%")).alias("ids"))
    marked = F.concat(F.lit(""), F.array_join(F.transform("all_", lambda i: F.when(i.isin("~", "#", "%"), i).otherwise(F.concat(F.lit("<"), i, F.lit(">")))), ""))
    marked = F.regexp_replace(F.replace(marked, F.lit("#~"), F.lit("%")), "<(?:Spdx|Either):([^>]*)>", "{$1}")
    for name, rule in rules:
        marked = F.regexp_replace(marked, pattern(rule), "{" + name + "}")
    return found.select(
        key,
        "n_sentences",
        F.size("ids").cast("long").alias("n_known"),
        F.array_join("ids", ",").alias("sentence_ids"),
        marked.alias("m"),
    ).select(
        key,
        "n_sentences",
        "n_known",
        "sentence_ids",
        F.array_join(F.regexp_extract_all("m", F.lit(r"\{([^}]*)\}"), F.lit(1)), ",").alias("licenses"),
        F.array_join(F.regexp_extract_all("m", F.lit("<([^>]*)>"), F.lit(1)), ",").alias("unmatched_ids"),
    )


def oracle() -> str:
    """DuckDB SQL for ``scan`` with all sentences, clauses, names, expressions and rules: sentences, the parts around notices, and lines as rows."""
    quote = lambda s: "'" + s.replace("'", "''").replace("\x01", "' || chr(1) || '").replace("\x02", "' || chr(2) || '") + "'"
    mapped = lambda d: "MAP {" + ", ".join(f"{quote(k)}: {quote(v)}" for k, v in d.items()) + "}"
    replaced = lambda s, how: f"regexp_replace({s}, {quote(how[0])}, {quote(re.sub(r'{(.)}', r'\\\1', how[1]))}, 'g')"
    normal = "trim(regexp_replace(lower({}), '[^a-z0-9]+', ' ', 'g'))"
    table = SENTENCES | MORE_SENTENCES
    spared = "coalesce(text, '')"
    for how in SPARED:
        spared = replaced(spared, how)
    clauses = " ".join(f"WHEN contains(t, {quote(words)}) AND regexp_matches(t, {quote(clause)}) THEN {quote(name)}" for name, words, clause in reversed(CLAUSES))
    called = lambda k: f"(SELECT n[regexp_extract(t, {quote(EITHER)}, {k})] FROM known)"
    either = f"WHEN regexp_matches(t, {quote(EITHER)}) THEN 'Either:' || {called(1)} || ' OR ' || {called(2)}"
    found = "coalesce((SELECT k[t] FROM known), CASE " + either + " " + clauses + " END)"
    line = "CASE WHEN starts_with(t, 'copyright ') THEN 'Copyright' ELSE " + found + " END"
    said = f"trim(regexp_replace(regexp_extract(line, {quote(SPDX)}, 1), '[\\x20\\x09]+', ' ', 'g'))"
    for how in OLDER:
        said = replaced(said, how)
    marked = "regexp_replace(replace(m, '#~', '%'), '<(?:Spdx|Either):([^>]*)>', '{\\1}', 'g')"
    for name, rule in MORE_RULES + RULES:
        marked = f"regexp_replace({marked}, {quote(pattern(rule))}, {quote('{' + name + '}')}, 'g')"
    some = " OR ".join(f"contains(lower(text), {quote(w)})" for w in anchors(table))
    cut = f"string_split(regexp_replace({replaced('lower(sentence)', NO_NOTICE)}, {quote(NOTICES)}, chr(10) || chr(10) || 'copyright notice' || chr(10) || chr(10), 'g'), chr(10) || chr(10))"
    return f"""
WITH known AS (SELECT {mapped({s: n for n, s in table.items()})} AS k, {mapped(NAMES)} AS n),
d AS (SELECT doc_id, coalesce({some}, false) AS looked, list_filter(regexp_split_to_array({spared}, {quote(CUTS)}), lambda x: regexp_matches(x, '[A-Za-z0-9]')) AS parts FROM documents),
s AS (SELECT doc_id, unnest(parts) AS sentence, generate_subscripts(parts, 1) AS pos FROM d WHERE looked),
w AS (SELECT doc_id, pos, sentence, {found} AS id FROM (SELECT *, {normal.format('sentence')} AS t FROM s)),
c AS (SELECT doc_id, pos, CASE WHEN contains(lower(sentence), 'copyright') THEN list_transform({cut}, lambda x: replace(x, 'copyri' || chr(2) || 'ht', 'copyright')) ELSE [sentence] END AS own FROM w WHERE id IS NULL),
p AS (SELECT doc_id, pos, sub, part, len(own) > 1 AS several, {found} AS id FROM (SELECT *, {normal.format('part')} AS t FROM (SELECT doc_id, pos, own, unnest(own) AS part, generate_subscripts(own, 1) AS sub FROM c))),
l AS (SELECT doc_id, pos, sub, unnest(string_split(part, chr(10))) AS line, generate_subscripts(string_split(part, chr(10)), 1) AS nth FROM p WHERE id IS NULL),
m AS (SELECT doc_id, pos, sub, nth, coalesce({line}, CASE WHEN contains(lower(line), 'spdx-license-identifier') THEN 'Spdx:' || nullif({said}, '') END) AS id FROM (SELECT *, {normal.format('line')} AS t FROM l)),
i AS (SELECT doc_id, pos, 0 AS sub, 0 AS nth, id FROM w WHERE id IS NOT NULL UNION ALL SELECT doc_id, pos, sub, 0, id FROM p WHERE id IS NOT NULL UNION ALL SELECT doc_id, pos, sub, nth, id FROM m WHERE id IS NOT NULL),
u AS (SELECT doc_id, pos, sub, nth, id, '<' || id || '>' AS mark FROM i
      UNION ALL SELECT doc_id, pos, 0, 0, NULL, CASE WHEN regexp_matches({normal.format('sentence')}, '{NUMBER}') THEN '#' WHEN regexp_matches(sentence, {quote(NUMBERED)}) THEN '%' ELSE '~' END FROM s WHERE (doc_id, pos) NOT IN (SELECT (doc_id, pos) FROM i)),
g AS (SELECT doc_id, count(id)::BIGINT AS n_known, string_agg(id, ',' ORDER BY pos, sub, nth) AS sentence_ids, string_agg(mark, '' ORDER BY pos, sub, nth) AS m FROM u GROUP BY doc_id),
r AS (SELECT d.doc_id, len(d.parts)::BIGINT AS n_sentences, coalesce(g.n_known, 0) AS n_known, coalesce(g.sentence_ids, '') AS sentence_ids, coalesce({marked}, '') AS m FROM d LEFT JOIN g USING (doc_id))
SELECT doc_id, n_sentences, n_known, sentence_ids,
       array_to_string(regexp_extract_all(m, '\\{{([^}}]*)\\}}', 1), ',') AS licenses,
       array_to_string(regexp_extract_all(m, '<([^>]*)>', 1), ',') AS unmatched_ids
FROM r
"""
