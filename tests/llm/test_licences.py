"""Known texts, wrapped and commented forms, gaps; the prefilter loses nothing; odd rows."""

import re

from countspark.llm import licences as lc

MIT = "\n".join(lc.SENTENCES[f"MIT-{x}"] for x in ("GRANT", "NOTICE", "AS-IS", "LIABILITY"))
APACHE = """   Licensed under the Apache License, Version 2.0 (the "License");
   you may not use this file except in compliance with the License.
   You may obtain a copy of the License at

       http://www.apache.org/licenses/LICENSE-2.0

   Unless required by applicable law or agreed to in writing, software
   distributed under the License is distributed on an "AS IS" BASIS,
   WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
   See the License for the specific language governing permissions and
   limitations under the License.
"""
GPL = """ * This program is free software: you can redistribute it and/or modify
 * it under the terms of the GNU General Public License as published by
 * the Free Software Foundation, either version 3 of the License, or
 * (at your option) any later version.
"""


def test_every_known_sentence_has_an_anchor():
    assert all(any(a in s for a in lc.ANCHORS) or any(a in re.sub(" +", " ", s) for a in lc.ANCHORS) for s in map(str.lower, lc.SENTENCES.values()))
    for phrase in lc.PHRASES:
        for name in lc.NAMES:
            assert any(a in f"{phrase} {name}".lower() for a in lc.ANCHORS), (phrase, name)


def test_scan(spark):
    wrapped = re.sub(r"(.{50,70}) ", r"\1\n# ", "# Copyright (c) 2020 Someone\n#\n# " + MIT.replace("\n", "\n#\n# "))
    rows = [(1, MIT, "MIT"), (2, "prose first.\n" + APACHE + "more prose", "Apache-2.0"), (3, GPL, "GPL-3.0-or-later"), (4, wrapped, "MIT"), (5, "Words.\nLicensed under CC BY-NC 4.0.", "CC-BY-NC-4.0"),
            (6, "Released under the MIT License. This work is licensed under the GNU General Public License, version 3.", "MIT,GPL-3.0"), (7, None, ""), (8, "", ""), (9, "We talk about a license.", ""),
            (10, lc.SENTENCES["MIT-GRANT"] + " Other words here. " + lc.SENTENCES["MIT-NOTICE"], ""), (None, MIT, "MIT"), (11, "x y. " * 200000 + MIT, "MIT"), (11, "All rights reserved.", "")]
    docs = spark.createDataFrame([(i, t, "l", 2) for i, t, _ in rows], "doc_id bigint, text string, licences string, low int")
    got = sorted((r["doc_id"] or -1, r["licences"]) for r in lc.scan_licences(docs).collect())
    assert got == sorted((i or -1, want) for i, _, want in rows)
    assert lc.scan_licences(docs.limit(0)).count() == 0
    plan = lc.scan_licences(docs)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Exchange" not in plan and "Arrow" not in plan


BSD_LIABILITY = """IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT
NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT
LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.""".replace("\n", " ")
FREE = {"COPYRIGHT": "Copyright (c) 2020 Someone", "BSD-LIABILITY": BSD_LIABILITY, "GNU-MERCHANT": "without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.",
        "BSD-ENDORSE": "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."}


def test_every_rule_on_its_text_wrapped_and_not(spark):
    rows = []
    for name, ids in lc.RULES:
        if ids.startswith("IS-"):
            texts = [f"{phrase} the {written}." for phrase in lc.PHRASES for written, of in lc.NAMES.items() if of == name]
        else:
            texts = [" ".join((lc.SENTENCES | FREE)[i].strip() for i in ids.split())]
        for text in texts:
            w = text.split()
            forms = [text, "\n".join(w), *("\n".join(head + " ".join(w[at:at + 7]) for at in range(0, len(w), 7)) for head in ("", "# ", " * ", "// "))]
            rows += [(len(rows) + k, form, name, "".join(f"<{i}>" for i in ids.split())) for k, form in enumerate(forms)]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id bigint, text string")
    got = {r["doc_id"]: r for r in lc.scan_licences(docs).collect()}
    wrong = [(t, got[i]["licences"], want) for i, t, want, _ in rows if got[i]["licences"] != want]
    assert not wrong, (len(wrong), wrong[:3])
    # the link of the Apache licence ends at a blank line, see test_scan
    short = [(t, got[i]["sequence"], seq) for i, t, _, seq in rows if "APACHE-URL" not in seq and got[i]["n_known"] < seq.count("<")]
    assert not short, (len(short), short[:3])  # the whole rule, and not only its short form
