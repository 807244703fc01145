"""The registered license scan knows more than the lines of the supplied rows."""

from twinweave.llm import license_templates, licenses
from twinweave.llm.common import alnum_words
from twinweave.llm.queries import op7_licenses

NOTICES = [
    ("Licensed under the MIT License", "MIT"),
    ("This file is licensed under the BSD 3-Clause License.", "BSD-3-Clause-line"),
    ("Mozilla Public License, Version 2.0 applies", "MPL-2.0-line"),
    ("covered by the GNU Lesser General Public License, version 2.1", "LGPL-2.1-line"),
    ("see the GNU Affero General Public License version 3", "AGPL-3.0-line"),
    ("under the GNU General Public License, version 2, only", "GPL-2.0-line"),
    ("Released under CC BY 4.0", "CC-BY-4.0-line"),
    ("Creative Commons Attribution-ShareAlike 4.0 International", "CC-BY-SA-4.0-line"),
    ("Distributed under CC0 1.0", "CC0-1.0-line"),
]


def test_whole_set(spark, tmp_path):
    texts = license_templates.public_templates()
    whole = {n: t[0] for n, t in texts.items() if n.endswith("-text")}
    rows = [t for t, _ in NOTICES] + [f"before\n{t}\nafter" for t in whole.values()] + [None, "", "Licensed under the moon of April"]
    rows += [rows[0]]  # a repeated row is scanned again
    spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {(r.doc_id, r.license_id): (r.n_matched, r.n_template) for r in op7_licenses(spark, str(tmp_path)).collect()}

    def sh(t):
        w = alnum_words(t or "")
        return {tuple(w[i : i + 5]) for i in range(len(w) - 4)}

    want = {}
    wordings = [(name, sh(t)) for name, all_ in texts.items() for t in all_]
    for i, t in enumerate(rows):
        d = sh(t)
        for name, s in wordings:
            if s and len(d & s) >= licenses.CONTAINMENT * len(s):
                want[i, name] = max(want.get((i, name), (0, 0)), (len(d & s), -len(s)))
    assert got == {k: (a, -b) for k, (a, b) in want.items()}
    assert all((i, name) in got for i, (_, name) in enumerate(NOTICES))
    assert all(any((i, name) == k for k in got) for i, name in enumerate(whole, len(NOTICES)))
    assert all(1 <= len(sh(t)) <= 4 for lines in license_templates.LINES.values() for t in lines)
