"""License scans by sentence rules (operator 5), in DataFrame expressions only.

A text is lower-cased (A-Z) and normalised to words of ``a-z0-9``; this drops
comment marks.  ``.!?`` before white space and blank lines end a sentence; a line
end, ``;`` or ``:`` may end one or stand in one, so that wrapped texts and lines
that stand alone are both found.  Sentences that the table SENTENCES knows, the
longest first and with or without one of LEADS before them, become identifiers;
all others drop out.  RULES are matched against the sequence of identifiers in their
order; a rule that matches consumes what it matched and leaves a gap that no
other rule matches across, so a long licence is not found again as the short ones
it contains.  A line or sentence of GAP_WORDS words or more that the table does not know (copyrights
and addresses aside) is such a gap too: conditions that a licence does not
have make it another.  Where a licence names its holder (HOLDERS), any name will do.
An SPDX expression names each licence in it, whatever joins them; ``+`` is "or later",
what stands behind WITH is left out.  A reservation of all rights counts only where no licence is found.

Only texts that hold one of WORDS are normalised; every known sentence has one.

Defined results: a null or empty text has no sentences and no licences; a very
long text is one row like any other; of sentences that begin at one place the
longest counts; repeated rows are scanned alike; an empty table gives an empty
result; columns other than doc_id and text are not read, whatever their names.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LOWER, UPPER, doc_text

# Licences that are named by an identifier in a tag.
TAGS = ("Apache-2.0", "MIT", "BSD-2-Clause", "BSD-3-Clause", "ISC", "Zlib", "BSL-1.0", "GPL-2.0-only", "GPL-2.0-or-later", "GPL-3.0-only", "GPL-3.0-or-later", "LGPL-2.1-only", "LGPL-2.1-or-later", "LGPL-3.0-only", "LGPL-3.0-or-later", "AGPL-3.0-only", "AGPL-3.0-or-later", "MPL-2.0", "EPL-1.0", "EPL-2.0", "CDDL-1.0", "Unlicense", "CC0-1.0", "CC-BY-4.0", "CC-BY-SA-4.0", "CC-BY-NC-4.0", "OFL-1.1", "Artistic-2.0", "PostgreSQL", "0BSD")

# Normalised sentences of published licence texts and notices, by identifier.
SENTENCES: dict[str, str] = {
    "licensed under the apache license version 2 0": "apache2_notice",
    "licensed under the apache license version 2 0 the license": "apache2_notice",
    "you may not use this file except in compliance with the license": "apache2_comply",
    "you may obtain a copy of the license at": "apache2_obtain",
    "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied": "apache2_as_is",
    "see the license for the specific language governing permissions and limitations under the license": "apache2_see",
    "apache license": "apache_title",
    "version 2 0 january 2004": "apache2_date",
    "released under the mit license": "mit_notice",
    "licensed under the mit license": "mit_notice",
    "this project is licensed under the mit license": "mit_notice",
    "mit license": "mit_title",
    "the mit license": "mit_title",
    "the mit license mit": "mit_title",
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions": "mit_grant",
    "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software": "mit_notice_kept",
    "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement": "mit_warranty",
    "in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software": "mit_liability",
    "except as contained in this notice the name of the x consortium shall not be used in advertising or otherwise to promote the sale use or other dealings in this software without prior written authorization from the x consortium": "x11_name",
    "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met": "bsd_grant",
    "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer": "bsd_source",
    "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution": "bsd_binary",
    "all advertising materials mentioning features or use of this software must display the following acknowledgement": "bsd_advertising",
    "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission": "bsd_endorse",
    "this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed": "bsd_warranty",
    "in no event shall the copyright holder or contributors be liable for any direct indirect incidental special exemplary or consequential damages including but not limited to procurement of substitute goods or services loss of use data or profits or business interruption however caused and on any theory of liability whether in contract strict liability or tort including negligence or otherwise arising in any way out of the use of this software even if advised of the possibility of such damage": "bsd_liability",
    "released under the bsd license": "bsd_notice",
    "licensed under the bsd license": "bsd_notice",
    "isc license": "isc_title",
    "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies": "isc_grant",
    "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted": "zero_bsd_grant",
    "the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness": "isc_warranty",
    "this software is provided as is without any express or implied warranty": "zlib_warranty",
    "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions": "zlib_grant",
    "the origin of this software must not be misrepresented you must not claim that you wrote the original software": "zlib_origin",
    "boost software license version 1 0 august 17th 2003": "bsl_title",
    "distributed under the boost software license version 1 0": "bsl_notice",
    "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license the software to use reproduce display distribute execute and transmit the software and to prepare derivative works of the software and to permit third parties to whom the software is furnished to do so all subject to the following": "bsl_grant",
    "this work is licensed under the gnu general public license version 3": "gpl3_notice",
    "licensed under the gnu general public license version 3": "gpl3_notice",
    "licensed under the gnu general public license version 2": "gpl2_notice",
    "gnu general public license": "gpl_title",
    "version 3 29 june 2007": "gpl3_date",
    "version 2 june 1991": "gpl2_date",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version": "gpl3_later",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version": "gpl2_later",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license version 2 as published by the free software foundation": "gpl2_only",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation version 3 of the license": "gpl3_only",
    "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose": "gnu_hope",
    "see the gnu general public license for more details": "gnu_details",
    "you should have received a copy of the gnu general public license along with this program": "gnu_received",
    "everyone is permitted to copy and distribute verbatim copies of this license document but changing it is not allowed": "gnu_verbatim",
    "licensed under the gnu lesser general public license version 3": "lgpl3_notice",
    "gnu lesser general public license": "lgpl_title",
    "version 2 1 february 1999": "lgpl21_date",
    "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 2 1 of the license or at your option any later version": "lgpl21_later",
    "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 3 of the license or at your option any later version": "lgpl3_later",
    "licensed under the gnu affero general public license version 3": "agpl3_notice",
    "gnu affero general public license": "agpl_title",
    "version 3 19 november 2007": "agpl3_date",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any later version": "agpl3_later",
    "licensed under cc by nc 4 0": "cc_by_nc4_notice",
    "licensed under cc by 4 0": "cc_by4_notice",
    "licensed under cc by sa 4 0": "cc_by_sa4_notice",
    "this work is licensed under a creative commons attribution 4 0 international license": "cc_by4_notice",
    "this work is licensed under a creative commons attribution noncommercial 4 0 international license": "cc_by_nc4_notice",
    "this work is licensed under a creative commons attribution sharealike 4 0 international license": "cc_by_sa4_notice",
    "this work is licensed under a creative commons attribution noderivatives 4 0 international license": "cc_by_nd4_notice",
    "this work is licensed under a creative commons attribution noncommercial sharealike 4 0 international license": "cc_by_nc_sa4_notice",
    "this work is licensed under a creative commons attribution sharealike 3 0 unported license": "cc_by_sa3_notice",
    "creative commons attribution 4 0 international public license": "cc_by4_title",
    "creative commons attribution sharealike 4 0 international public license": "cc_by_sa4_title",
    "creative commons attribution noncommercial 4 0 international public license": "cc_by_nc4_title",
    "cc0 1 0 universal": "cc0_title",
    "licensed under the mozilla public license version 2 0": "mpl2_notice",
    "mozilla public license version 2 0": "mpl2_title",
    "this source code form is subject to the terms of the mozilla public license v 2 0": "mpl2_form",
    "this source code form is subject to the terms of the mozilla public license v": "mpl2_form",
    "if a copy of the mpl was not distributed with this file you can obtain one at": "mpl2_obtain",
    "eclipse public license v 1 0": "epl1_title",
    "eclipse public license v 2 0": "epl2_title",
    "the accompanying program is provided under the terms of this eclipse public license": "epl_terms",
    "this program and the accompanying materials are made available under the terms of the eclipse public license 2 0 which is available at": "epl2_notice",
    "common development and distribution license cddl version 1 0": "cddl1_title",
    "european union public licence v 1 2": "eupl12_title",
    "licensed under the eupl": "eupl_notice",
    "this is free and unencumbered software released into the public domain": "unlicense",
    "anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means": "unlicense_free",
    "do what the fuck you want to public license": "wtfpl_title",
    "you just do what the fuck you want to": "wtfpl_do",
    "the artistic license 2 0": "artistic2_title",
    "permission to use copy modify and distribute this software and its documentation for any purpose without fee and without a written agreement is hereby granted provided that the above copyright notice and this paragraph and the following two paragraphs appear in all copies": "postgresql_grant",
    "sil open font license version 1 1 26 february 2007": "ofl_title",
    "this font software is licensed under the sil open font license version 1 1": "ofl_notice",
    "microsoft public license ms pl": "mspl_title",
    "python software foundation license version 2": "psf2_title",
    "university of illinois ncsa open source license": "ncsa_title",
    "all rights reserved": "all_rights",
}
# What a sentence says before and after the name of a holder, and the name that it has in the table.
HOLDERS = [
    ("neither the name of", "the copyright holder", "nor the names of its contributors may be used to endorse"),
    ("this software is provided by", "the copyright holders and contributors", "as is and any express or implied warranties"),
    ("in no event shall", "the copyright holder or contributors", "be liable for any direct indirect incidental"),
]
#: Words of an unknown sentence that no rule matches across.
GAP_WORDS = 5
# Older SPDX identifiers for what they mean now.
OLD_TAGS = {"GPL-2.0": "GPL-2.0-only", "GPL-3.0": "GPL-3.0-only", "LGPL-2.1": "LGPL-2.1-only", "LGPL-3.0": "LGPL-3.0-only", "AGPL-3.0": "AGPL-3.0-only"}
SENTENCES |= {"spdx license identifier " + x.lower().replace("-", " ").replace(".", " "): f"tag_{x}" for x in TAGS}
SENTENCES |= {"spdx license identifier " + old.lower().replace("-", " ").replace(".", " "): f"tag_{new}" for old, new in OLD_TAGS.items()}

# Ordered rules, the longest sequences of a licence before its parts.
RULES: list[tuple[str, tuple[str, ...]]] = [
    ("Apache-2.0", ("apache2_notice", "apache2_comply", "apache2_obtain", "apache2_as_is", "apache2_see")),
    ("Apache-2.0", ("apache2_notice", "apache2_comply", "apache2_obtain", "apache2_see")),
    ("Apache-2.0", ("apache2_notice", "apache2_comply")),
    ("Apache-2.0", ("apache_title", "apache2_date")),
    ("Apache-2.0", ("apache2_notice",)),
    ("NCSA", ("ncsa_title", "mit_grant")),
    ("BSD-4-Clause", ("bsd_grant", "bsd_source", "bsd_binary", "bsd_advertising", "bsd_endorse", "bsd_warranty", "bsd_liability")),
    ("BSD-4-Clause", ("bsd_source", "bsd_binary", "bsd_advertising")),
    ("BSD-3-Clause", ("bsd_grant", "bsd_source", "bsd_binary", "bsd_endorse", "bsd_warranty", "bsd_liability")),
    ("BSD-3-Clause", ("bsd_source", "bsd_binary", "bsd_endorse")),
    ("BSD-2-Clause", ("bsd_grant", "bsd_source", "bsd_binary", "bsd_warranty", "bsd_liability")),
    ("BSD-2-Clause", ("bsd_source", "bsd_binary")),
    ("BSD", ("bsd_notice",)),
    ("X11", ("mit_grant", "mit_notice_kept", "mit_warranty", "x11_name")),
    ("MIT", ("mit_title", "mit_grant", "mit_notice_kept", "mit_warranty", "mit_liability")),
    ("MIT", ("mit_grant", "mit_notice_kept", "mit_warranty", "mit_liability")),
    ("MIT", ("mit_title", "mit_notice_kept", "mit_warranty")),
    ("MIT", ("mit_notice_kept", "mit_warranty")),
    ("MIT", ("mit_notice",)),
    ("MIT", ("mit_title",)),
    ("ISC", ("isc_title", "isc_grant", "isc_warranty")),
    ("ISC", ("isc_grant",)),
    ("ISC", ("isc_title",)),
    ("0BSD", ("zero_bsd_grant", "isc_warranty")),
    ("0BSD", ("zero_bsd_grant",)),
    ("Zlib", ("zlib_warranty", "zlib_grant", "zlib_origin")),
    ("Zlib", ("zlib_grant",)),
    ("BSL-1.0", ("bsl_title", "bsl_grant")),
    ("BSL-1.0", ("bsl_notice",)),
    ("BSL-1.0", ("bsl_title",)),
    ("BSL-1.0", ("bsl_grant",)),
    ("AGPL-3.0-only", ("agpl_title", "agpl3_date", "gnu_verbatim")),
    ("AGPL-3.0-only", ("agpl_title", "agpl3_date")),
    ("LGPL-2.1-only", ("lgpl_title", "lgpl21_date", "gnu_verbatim")),
    ("LGPL-2.1-only", ("lgpl_title", "lgpl21_date")),
    ("LGPL-3.0-only", ("lgpl_title", "gpl3_date")),
    ("GPL-3.0-only", ("gpl_title", "gpl3_date", "gnu_verbatim")),
    ("GPL-3.0-only", ("gpl_title", "gpl3_date")),
    ("GPL-2.0-only", ("gpl_title", "gpl2_date", "gnu_verbatim")),
    ("GPL-2.0-only", ("gpl_title", "gpl2_date")),
    ("GPL-3.0-or-later", ("gpl3_later", "gnu_hope", "gnu_details", "gnu_received")),
    ("GPL-3.0-or-later", ("gpl3_later",)),
    ("GPL-2.0-or-later", ("gpl2_later", "gnu_hope", "gnu_details", "gnu_received")),
    ("GPL-2.0-or-later", ("gpl2_later",)),
    ("GPL-2.0-only", ("gpl2_only",)),
    ("GPL-3.0-only", ("gpl3_only",)),
    ("GPL-3.0-only", ("gpl3_notice",)),
    ("GPL-2.0-only", ("gpl2_notice",)),
    ("LGPL-2.1-or-later", ("lgpl21_later",)),
    ("LGPL-3.0-or-later", ("lgpl3_later",)),
    ("LGPL-3.0-only", ("lgpl3_notice",)),
    ("AGPL-3.0-or-later", ("agpl3_later",)),
    ("AGPL-3.0-only", ("agpl3_notice",)),
    ("CC-BY-NC-4.0", ("cc_by_nc4_notice",)),
    ("CC-BY-NC-4.0", ("cc_by_nc4_title",)),
    ("CC-BY-SA-4.0", ("cc_by_sa4_notice",)),
    ("CC-BY-SA-4.0", ("cc_by_sa4_title",)),
    ("CC-BY-4.0", ("cc_by4_notice",)),
    ("CC-BY-4.0", ("cc_by4_title",)),
    ("CC-BY-ND-4.0", ("cc_by_nd4_notice",)),
    ("CC-BY-NC-SA-4.0", ("cc_by_nc_sa4_notice",)),
    ("CC-BY-SA-3.0", ("cc_by_sa3_notice",)),
    ("CC0-1.0", ("cc0_title",)),
    ("MPL-2.0", ("mpl2_notice",)),
    ("MPL-2.0", ("mpl2_form", "mpl2_obtain")),
    ("MPL-2.0", ("mpl2_form",)),
    ("MPL-2.0", ("mpl2_title",)),
    ("EPL-1.0", ("epl1_title",)),
    ("EPL-2.0", ("epl2_title",)),
    ("EPL-2.0", ("epl2_notice",)),
    ("CDDL-1.0", ("cddl1_title",)),
    ("EUPL-1.2", ("eupl12_title",)),
    ("EUPL", ("eupl_notice",)),
    ("Unlicense", ("unlicense", "unlicense_free")),
    ("Unlicense", ("unlicense",)),
    ("WTFPL", ("wtfpl_title", "wtfpl_do")),
    ("WTFPL", ("wtfpl_title",)),
    ("Artistic-2.0", ("artistic2_title",)),
    ("PostgreSQL", ("postgresql_grant",)),
    ("OFL-1.1", ("ofl_notice", "ofl_title")),
    ("OFL-1.1", ("ofl_notice",)),
    ("OFL-1.1", ("ofl_title",)),
    ("MS-PL", ("mspl_title",)),
    ("PSF-2.0", ("psf2_title",)),
    ("NCSA", ("ncsa_title",)),
    *((x, (f"tag_{x}",)) for x in TAGS),
    ("Proprietary", ("all_rights",)),
]
RESERVED = "Proprietary"
# Parts of words, one of which every sentence of the table holds.
WORDS = ("licen", "copyright", "warrant", "permission", "permitted", "version", "damages", "redistribut", "advertising", "endorse", "misrepresented", "universal", "public", "distribute", "rights reserved", "mpl was", "want to")


# What may stand before a known sentence.
LEADS = tuple(f"{a} {b} is" for a in ("this", "the") for b in ("code", "file", "library", "module", "package", "program", "project", "repository", "software", "source code", "work"))

#: Ends a sentence for certain; texts hold none, as it is read as a space.
_END = "\x01"


#: Between the parts of ``marked`` text: known sentences stand between two.
_KNOWN = "\x02"
_NAME = f"[a-z0-9 \n;:{_END}]{{1,150}}?[ \n;:{_END}]+"


def _sentence_pattern() -> str:
    """A known sentence (group 1) between ends, over words and the marks ``_END``, line end, ``;`` and ``:`` without spaces around them."""
    gap = r"(?: |[;:]+\n?[;:]*|\n[;:]*)"

    def written(x: str) -> str:
        for before, name, after in HOLDERS:
            if x.startswith(f"{before} {name} {after}"):
                return before.replace(" ", gap) + gap + _NAME + x[len(f"{before} {name} ") :].replace(" ", gap)
        return x.replace(" ", gap)

    any_of = lambda known: "|".join(map(written, sorted(known, key=len, reverse=True)))
    return f"(?<![a-z0-9 ])(?:(?:{any_of(LEADS)}){gap})?({any_of(SENTENCES)})(?![a-z0-9 ])"


def _of_table(sentence: Column) -> Column:
    """A sentence that was found as the table writes it: any holder's name as the one there."""
    out = F.regexp_replace(sentence, f"[\n;:{_END}]+", " ")
    for before, name, after in HOLDERS:
        out = F.regexp_replace(out, f"^{before} .+ {after}", f"{before} {name} {after}")
    return out


def _spdx_lines(text: Column) -> Column:
    """Each licence of an SPDX expression in a line of its own."""
    tag = r"(?<=SPDX-License-Identifier:[^\n]{0,250})"
    out = F.regexp_replace(text, rf"(?i){tag}[\x20\t]+WITH[\x20\t]+[A-Za-z0-9.-]+", "")
    out = F.regexp_replace(out, rf"(?i){tag}\b([A-Za-z0-9.-]+)\+", "$1-or-later")
    return F.regexp_replace(out, rf"(?i){tag}[\x20\t)]+(?:OR|AND)[\x20\t(]+", "\nSPDX-License-Identifier: ")


def _unknown(part: Column) -> Column:
    """Whether a line or sentence of what stands between two known ones is a gap."""
    words = lambda x: F.size(F.array_remove(F.split(x, "[ ;:]+"), ""))
    return F.exists(F.split(part, f"[\n{_END}]"), lambda x: ~x.contains("copyright") & ~x.contains("http") & (words(x) >= GAP_WORDS))


def sentences(text: Column) -> Column:
    """Identifiers of the known sentences of a text, in order, and ``;`` where there is a gap between two."""
    plain_text = F.coalesce(text, F.lit(""))
    plain_text = F.when(F.lower(plain_text).contains("spdx-license-identifier"), _spdx_lines(plain_text)).otherwise(plain_text)
    lower = F.translate(plain_text, UPPER + _END + _KNOWN, LOWER + "  ")
    cut_ = F.regexp_replace(lower, r"[.!?]+[\x20\x09-\x0D]", _END)
    plain = F.regexp_replace(cut_, rf"[^a-z0-9\n;:{_END}]+", " ")
    marked = F.btrim(F.regexp_replace(plain, rf" ?([\n;:{_END}]) ?", "$1"))
    parts = F.split(F.regexp_replace(marked, _sentence_pattern(), f"{_KNOWN}$1{_KNOWN}"), _KNOWN)  # what is not known first and last
    table = F.create_map(*(F.lit(x) for pair in SENTENCES.items() for x in pair))
    inner = F.slice(parts, 2, F.greatest(F.size(parts) - 2, F.lit(0)))
    ids = F.array_compact(F.transform(inner, lambda x, i: F.when(i % 2 == 0, table[_of_table(x)]).when(_unknown(x), F.lit(";"))))
    some = reduce(lambda a, b: a | b, (lower.contains(w) for w in WORDS if " " not in w))
    # A word pair of WORDS may be wrapped: its first word decides.
    some = reduce(lambda a, b: a | b, (lower.contains(w.split()[0]) for w in WORDS if " " in w), some)
    return F.when(some, ids).otherwise(F.array().cast("array<string>"))


def sentence_ids(text: Column) -> Column:
    """Identifiers of the known sentences of a text, in order."""
    return F.array_remove(sentences(text), ";")


def _written(ids: tuple[str, ...]) -> str:
    return "".join(f",{x}," for x in ids)


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, sentence_ids (comma-separated, in order), n_sentences, licenses (comma-separated, in rule order), unmatched (identifiers no rule took)."""
    found = doc_text(docs).select("doc_id", sentences(F.col("text")).alias("all")).withColumn("ids", F.array_remove("all", ";"))
    sequence = F.transform("all", lambda x: F.when(x == ";", x).otherwise(F.concat(F.lit(","), x, F.lit(","))))
    found = found.select("doc_id", F.size("ids").cast("long").alias("n_sentences"), F.array_join("ids", ",").alias("sentence_ids"), F.array_join(sequence, "").alias("rest"))
    # One fold over the rules: what is left, and the names found so far.
    rules = F.array(*(F.struct(F.lit(name).alias("name"), F.lit(_written(ids)).alias("ids")) for name, ids in RULES))
    start = F.struct(F.col("rest").alias("rest"), F.array().cast("array<string>").alias("names"))
    step = lambda acc, r: F.struct(F.replace(acc["rest"], r["ids"], F.lit(";")).alias("rest"), F.when(acc["rest"].contains(r["ids"]), F.array_append(acc["names"], r["name"])).otherwise(acc["names"]).alias("names"))
    done = found.withColumn("done", F.when(F.col("n_sentences") > 0, F.aggregate(rules, start, step)))
    names = F.array_distinct(F.col("done.names"))
    names = F.when(F.size(names) > 1, F.array_remove(names, RESERVED)).otherwise(names)
    return done.select("doc_id", "n_sentences", "sentence_ids", F.coalesce(F.array_join(names, ","), F.lit("")).alias("licenses"), F.coalesce(F.btrim(F.regexp_replace("done.rest", "[,;]+", ","), F.lit(",")), F.lit("")).alias("unmatched"))


def scan_sql() -> str:
    """The same in DuckDB SQL for texts in which no known sentence is wrapped, follows ``;`` or ``:`` in a line, or has a lead-in, and no SPDX expression has several licences."""
    q = lambda s: "'" + s.replace("'", "''") + "'"
    table = f"MAP {{{', '.join(f'{q(k)}: {q(v)}' for k, v in SENTENCES.items())}}}"
    steps, last = [], "s0"
    for i, (_, ids) in enumerate(RULES):
        steps.append(f"s{i + 1} AS (SELECT * EXCLUDE (rest), contains(rest, {q(_written(ids))}) AS hit_{i}, replace(rest, {q(_written(ids))}, ';') AS rest FROM {last})")
        last = f"s{i + 1}"
    names = ", ".join(f"CASE WHEN hit_{i} THEN {q(name)} END" for i, (name, _) in enumerate(RULES))
    sentence = "s"
    for before, name, after in HOLDERS:
        sentence = f"regexp_replace({sentence}, '^{before} .+ {after}', '{before} {name} {after}')"
    gap = f"CASE WHEN contains(s, 'copyright') OR contains(s, 'http') OR len(string_split(s, ' ')) < {GAP_WORDS} THEN '' ELSE ';' END"
    return f"""WITH cut AS (
  SELECT doc_id, list_transform(list_transform(string_split(regexp_replace(regexp_replace(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[.!?]+[\\x20\\x09-\\x0D]', chr(10), 'g'), '[^a-z0-9\\n]+', ' ', 'g'), chr(10)), lambda s: trim(s, ' ')), lambda s: {sentence}) AS pieces FROM documents),
ids AS (SELECT doc_id, list_transform(list_filter(pieces, lambda s: map_contains({table}, s)), lambda s: {table}[s]) AS ids,
  array_to_string(list_transform(pieces, lambda s: CASE WHEN map_contains({table}, s) THEN ',' || {table}[s] || ',' ELSE {gap} END), '') AS rest FROM cut),
s0 AS (SELECT doc_id, len(ids)::BIGINT AS n_sentences, coalesce(array_to_string(ids, ','), '') AS sentence_ids, coalesce(rest, '') AS rest FROM ids),
{", ".join(steps)},
named AS (SELECT doc_id, n_sentences, sentence_ids, rest, [{names}] AS all_names FROM {last}),
kept AS (SELECT *, list_filter(all_names, lambda x, i: x IS NOT NULL AND list_position(all_names, x) = i) AS names FROM named)
SELECT doc_id, n_sentences, sentence_ids,
  coalesce(array_to_string(list_filter(names, lambda x: len(names) = 1 OR x <> '{RESERVED}'), ','), '') AS licenses,
  trim(regexp_replace(rest, '[,;]+', ',', 'g'), ',') AS unmatched FROM kept"""
