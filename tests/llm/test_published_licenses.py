"""Licences that look like others: other conditions, other holders, expressions of several."""

import duckdb
from test_operators import make

from lodestar.llm import licenses

GRANT = next(s for s, i in licenses.SENTENCES.items() if i == "mit_grant").replace("mit_grant", "")
KEPT = "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."
WARRANTY = "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT."
BSD = """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

   * Redistributions of source code must retain the above copyright
notice, this list of conditions and the following disclaimer.
   * Redistributions in binary form must reproduce the above
copyright notice, this list of conditions and the following disclaimer
in the documentation and/or other materials provided with the
distribution.
   * Neither the name of {} nor the names of its
contributors may be used to endorse or promote products derived from
this software without specific prior written permission.

THIS SOFTWARE IS PROVIDED BY {} "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.
"""
APACHE = "Licensed under the Apache License, Version 2.0 (the \"License\");\nyou may not use this file except in compliance with the License.\nYou may obtain a copy of the License at\n\n    http://www.apache.org/licenses/LICENSE-2.0\n\nSee the License for the specific language governing permissions and\nlimitations under the License."


def found(spark, *texts):
    rows = {r["doc_id"]: r for r in licenses.scan(make(spark, [(i, t, None, None) for i, t in enumerate(texts)])).collect()}
    return [rows[i]["licenses"] for i in range(len(texts))], [rows[i]["unmatched"] for i in range(len(texts))]


def test_any_holder_endorses(spark):
    names = ["the copyright holder", "the University", "Google Inc.", "Foo & Bar, LLC", "the University of California, Berkeley"]
    got, rest = found(spark, *(BSD.format(n, n.upper() + " AND CONTRIBUTORS") for n in names))
    assert got == ["BSD-3-Clause"] * len(names) and rest == ["bsd_grant,bsd_warranty"] * len(names)


def test_other_conditions_make_another_licence(spark):
    evil = "The Software shall be used for Good, not Evil and for nothing else."
    texts = [f"{GRANT}:\n\n{KEPT}\n\n{WARRANTY}", f"The JSON License\n\n{GRANT}:\n\n{KEPT}\n\n{evil}\n\n{WARRANTY}", f"{GRANT}, but not on Sundays, for which see our other terms.", GRANT, APACHE, f"{KEPT}\n\nCopyright 2001 by A. Body, B. Body, C. Body and others\n\n(2)\n\n{WARRANTY}"]
    got, rest = found(spark, *texts)
    assert got == ["MIT", "", "", "", "Apache-2.0", "MIT"]
    assert rest[1] == "mit_grant,mit_notice_kept,mit_warranty" and rest[3] == "mit_grant" and rest[4] == ""


def test_spdx_expressions(spark):
    tag = "SPDX-License-Identifier: "
    texts = [f"// {tag}GPL-2.0-or-later OR MIT\ncode", f"/* {tag}(MIT OR Apache-2.0) */", f"# {tag}LGPL-2.1+", f"{tag}GPL-2.0-only WITH Classpath-exception-2.0", f"{tag}(GPL-3.0+ AND (BSD-3-Clause OR ISC)) WITH x", f"{tag}Apache-2.0\n{tag}MIT", f"{tag}Foo-1.0 OR MIT", f"{tag}GPL-2.0", "this or that OR MIT", f"{tag.lower()}mit or isc"]
    got, _ = found(spark, *texts)
    assert [set(x.split(",")) for x in got] == [{"GPL-2.0-or-later", "MIT"}, {"MIT", "Apache-2.0"}, {"LGPL-2.1-or-later"}, {"GPL-2.0-only"}, {"GPL-3.0-or-later", "BSD-3-Clause", "ISC"}, {"Apache-2.0", "MIT"}, {"MIT"}, {"GPL-2.0-only"}, {""}, {"MIT", "ISC"}]


def test_sql_has_the_same_gaps_and_holders(spark):
    one = lambda s: s.replace("\n", " ")
    texts = [f"{KEPT}\n{WARRANTY}", f"{KEPT}\nfour words are few\n{WARRANTY}", f"{KEPT}\nfive words are a gap\n{WARRANTY}", f"{KEPT}\nfive words\nare no gap\n{WARRANTY}", f"{KEPT}\nCopyright of five or more words\nhttp://a.b/c/d/e/f\n{WARRANTY}", "\n".join(one(x) for x in BSD.format("Foo Bar", "FOO").split("   * ")), "MIT License", None, "", "some text. More.\nMIT License\nsome more text that goes on", "Apache License\n\n\nVersion 2.0, January 2004"]
    docs = make(spark, [(i, t, None, None) for i, t in enumerate(texts)])
    con = duckdb.connect()
    con.register("documents", docs.select("doc_id", "text").toPandas())
    want = con.sql(f"SELECT doc_id, n_sentences, sentence_ids, licenses, unmatched FROM ({licenses.scan_sql()}) ORDER BY 1").fetchall()
    assert [tuple(r) for r in licenses.scan(docs).select("doc_id", "n_sentences", "sentence_ids", "licenses", "unmatched").orderBy("doc_id").collect()] == want
    assert [w[3] for w in want[:5]] == ["MIT", "MIT", "", "MIT", "MIT"]


def test_megabyte_text_and_clashing_columns(spark):
    docs = spark.createDataFrame([(1, "some words of prose " * 60_000 + ".\nMIT License\n" + "licence " * 200_000, 1, "x", 2)], "doc_id long, text string, ids int, rest string, done int")
    (r,) = licenses.scan(docs).collect()
    assert (r["licenses"], r["n_sentences"]) == ("MIT", 1)
