"""Licence texts as they are published: wrapped, in comments, with lead-ins."""

from lodestar.llm import licenses
from test_operators import make

MIT = """Copyright (c) 2020 A. Body

Permission is hereby granted, free of charge, to any person obtaining a copy.

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE
AUTHORS BE LIABLE.
"""

BSD = """ * Redistribution and use are permitted provided that the following
 * conditions are met:
 *
 * 1. Redistributions of source code must retain the above copyright notice, this
 *    list of conditions and the following disclaimer.
 *
 * 2. Redistributions in binary form must reproduce the above copyright notice,
 *    this list of conditions and the following disclaimer in the documentation
 *    and/or other materials provided with the distribution.
 *
 * 3. Neither the name of the copyright holder nor the names of its
 *    contributors may be used to endorse or promote products derived from
 *    this software without specific prior written permission.
"""

GPL = """# This program is free software: you can redistribute it and/or modify\r
# it under the terms of the GNU General Public License as published by\r
# the Free Software Foundation, either version {} of the License, or\r
# (at your option) any later version.\r
"""

APACHE = """// Licensed under the Apache License, Version 2.0 (the "License"); you may not use
// this file except in compliance with the License. You may obtain a copy of the
// License at
//
//     http://www.apache.org/licenses/LICENSE-2.0
//
// See the License for the specific language governing permissions and
// limitations under the License.
"""


def test_wrapped_texts_are_found(spark):
    texts = [MIT, BSD, GPL.format(3), GPL.format(2), APACHE, "This file is licensed\nunder the MIT License.", "MIT\n\nLicense", "mit\x01license", BSD[: BSD.index(" * 3.")]]
    got = {r["doc_id"]: r for r in licenses.scan(make(spark, [(i, t, None, None) for i, t in enumerate(texts)])).collect()}
    assert [got[i]["licenses"] for i in range(9)] == ["MIT", "BSD-3-Clause", "GPL-3.0-or-later", "GPL-2.0-or-later", "Apache-2.0", "MIT", "", "MIT", "BSD-2-Clause"]
    assert got[4]["sentence_ids"] == "apache2_notice,apache2_comply,apache2_obtain,apache2_see" and all(r["unmatched"] == "" for r in got.values())


def by_hand(text):
    """Rule order by plain Python, over the identifiers of whole lines."""
    rest = "".join(f",{licenses.SENTENCES[s]}," for s in text.split("\n"))
    names = []
    for name, ids in licenses.RULES:
        run = "".join(f",{x}," for x in ids)
        if run in rest:
            names, rest = names + [name] * (name not in names), rest.replace(run, ";")
    return ",".join(n for n in names if len(names) == 1 or n != licenses.RESERVED)


def test_every_sentence_and_rule_is_found(spark):
    """Each known sentence by itself, and each rule's sentences in order, wrapped after every third word."""
    of = {i: s for s, i in licenses.SENTENCES.items()}
    wrap = lambda s: "\n * ".join(" ".join(s.split()[i : i + 3]) for i in range(0, len(s.split()), 3))
    texts = [s for s in licenses.SENTENCES] + ["\n".join(of[i] for i in ids) for _, ids in licenses.RULES]
    rows = [(i, "\n\n".join(wrap(s) for s in t.split("\n")).upper(), None, None) for i, t in enumerate(texts)]
    got = {r["doc_id"]: r for r in licenses.scan(make(spark, rows)).collect()}
    for i, t in enumerate(texts):
        assert got[i]["sentence_ids"] == ",".join(licenses.SENTENCES[s] for s in t.split("\n")) and got[i]["licenses"] == by_hand(t), t
    assert len({name for name, _ in licenses.RULES}) >= 40


def test_rules_do_not_match_across_what_was_consumed(spark):
    texts = ["GNU General Public License\n\nLicensed under the Apache License, Version 2.0\n\nVersion 3, 29 June 2007", "Copyright (c) 2020 A. Body. All rights reserved.\n\n" + BSD, "Copyright 2020 A. Body. All rights reserved."]
    got = {r["doc_id"]: r["licenses"] for r in licenses.scan(make(spark, [(i, t, None, None) for i, t in enumerate(texts)])).collect()}
    assert got == {0: "Apache-2.0", 1: "BSD-3-Clause", 2: "Proprietary"}
