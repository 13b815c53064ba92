"""License scans against windows at every place, and the forms that notices take."""

import random
import textwrap

from weirflow.llm import licenses


def scan(spark, *texts):
    df = spark.createDataFrame([(k, t, "x", 1) for k, t in enumerate(texts)], "doc_id long, text string, licenses string, k0 int")
    return [[(x.license, x.first_line, x.last_line) for x in r.licenses] for r in licenses.license_scan(df).orderBy("doc_id").collect()]


def test_wrapped_commented_dual_and_tagged(spark):
    mit = licenses.TEMPLATES["MIT"]
    wrapped = textwrap.wrap(mit, 60)
    got = scan(
        spark,
        "\n".join(wrapped),
        "/*\n" + "\n".join(" * " + x for x in wrapped) + "\n */\nint x;",
        "\n".join("# " + x for x in textwrap.wrap(licenses.TEMPLATES["ISC"], 72)),
        "Released under the MIT License. Licensed under CC BY 4.0.",
        "// SPDX-License-Identifier: GPL-2.0-or-later\ncode",
        "# SPDX-License-Identifier: (Apache-2.0 OR MIT) AND BSD-3-Clause",
        licenses.TEMPLATES["BSD-3-Clause"] + "\n\n" + licenses.TEMPLATES["Zlib"],
        None,
        "",
        "MIT is a university, and a license to teach needs no permission.",
    )
    n = len(wrapped)
    assert got == [
        [("MIT", 0, n)],
        [("MIT", 1, n + 1)],
        [("ISC", 0, len(textwrap.wrap(licenses.TEMPLATES["ISC"], 72)))],
        [("MIT notice", 0, 1), ("CC-BY-4.0 short notice", 0, 1)],
        [("GPL-2.0-or-later tag", 0, 1)],
        [("Apache-2.0 tag", 0, 1), ("MIT tag", 0, 1), ("BSD-3-Clause tag", 0, 1)],
        [("BSD-3-Clause", 0, 1), ("Zlib", 2, 3)],
        [],
        [],
        [],
    ]


def test_ties_and_repeats(spark):
    one = "Released under the MIT License."
    assert scan(spark, f"{one}\n{one}\n{one}") == [[("MIT notice", k, k + 1) for k in range(3)]]
    assert scan(spark) == []


class EveryPlace(licenses.Scanner):
    """Windows of each template's length at every place of the text."""

    def windows(self, words):
        for t in self.templates:
            new = int(self.most_new * len(t.words))
            for i in range(-len(t.words), len(words)):
                a, b = max(0, i - new), min(len(words), i + len(t.words) + new)
                if a < b:
                    yield t, a, b


def test_against_every_place():
    rng = random.Random(71)
    chosen = {k: v for k, v in licenses.TEMPLATES.items() if len(licenses.wording(v)) < 90}
    plain, ours = EveryPlace(chosen), licenses.Scanner(chosen)
    filler = ["word", "license", "software", "the", "permission", "of", "any", "notice", "granted"]
    for _ in range(12):
        parts = []
        for _ in range(rng.randrange(1, 4)):
            words = chosen[rng.choice(sorted(chosen))].split()
            for _ in range(rng.randrange(0, 1 + len(words) // 6)):
                k = rng.randrange(len(words))
                words[k : k + rng.randrange(0, 2)] = rng.choice([[], ["changed"], [rng.choice(filler)]])
            parts += [rng.choice(filler) for _ in range(rng.randrange(0, 6))] + words
        text = " ".join(parts)
        want, got = plain.scan(text), ours.scan(text)
        assert got == want, text
