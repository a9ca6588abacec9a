"""License scans: notices however they are laid out, every rule without its gate, suppression, long texts."""

import random
import time

import pytest

from tessera.llm import licenses
from tessera.llm.words import PLAIN

SCANNER = licenses.Scanner()
EXAMPLES = [
    ("SPDX-License-Identifier: MIT", "mit"), ("// SPDX-License-Identifier: (MIT OR Apache-2.0)", "apache mit"), ("SPDX-License-Identifier: GPL-3.0-or-later WITH GCC-exception-3.1 AND BSD-3-Clause", "bsd gpl"), ('"license": "MIT"', "mit"),
    ("licensed under GPLv3", "gpl"), ("licensed under AGPL-3.0", "agpl"), ("This work is in the public domain.", "public-domain"), ("License :: OSI Approved :: BSD License", "bsd"),
    ("licensed under the GNU Lesser General Public License, version 2.1 or later", "lgpl"), ("https://www.apache.org/licenses/LICENSE-2.0", "apache"), ("see http://creativecommons.org/licenses/by-sa/4.0/", "cc-by-sa"),
    ("Permission is hereby granted, free of charge, to any person\n * obtaining a copy of this software", "mit"), ("Redistribution and use in source and binary forms,\nwith or without modification, are permitted", "bsd"),
    ("Creative  Commons\n    Attribution 4.0", "cc-by"), ("CC BY-NC-SA 4.0", "cc-by-nc"), ("dual licensed: MIT-licensed or the ISC license", "isc mit"), ("no license at all, a mit in the text", ""), ("general public, library", ""),
]


def words(text):
    return text.encode().translate(PLAIN).split()


def labels(text, gated=True):
    return " ".join(sorted({d[2] for d in SCANNER.detections(words(text), gated)}))


@pytest.mark.parametrize(("text", "want"), EXAMPLES)
def test_examples(text, want):
    assert labels(text) == want
    assert labels("\r\n\t* ".join(text.split())) == want


@pytest.mark.parametrize(("text", "label"), [("Creative\r\nCommons Attribution", "cc-by"), ("CC (BY) 4.0", "cc-by"), ("released under public\n * domain", "public-domain")])
def test_split_notices(spark, text, label):
    one = text.replace("\r\n", " ").replace("\n * ", " ").replace("(", "").replace(")", "")
    found = [{d.label for d in r.detections} for r in licenses.scan(spark.createDataFrame([(1, one), (2, text)], "doc_id long, text string")).orderBy("doc_id").collect()]
    assert found[0] == found[1] == {label}


def test_gates_lose_nothing():
    """Every rule on every text gives what rules at their keywords give; suppression is that of all pairs."""
    r = random.Random(1)
    vocabulary = sorted({w for line in licenses.SIGNATURES.split("\n") if line for w in line.split(" | ")[4].replace("(?:", " ").replace(")?", " ").replace("[cs]", "s").replace("|", " ").replace(")", " ").split() if w.isalnum()})
    parts = [t for t, _ in EXAMPLES]
    for _ in range(150):
        text = " ".join(r.choice([r.choice(vocabulary), r.choice(parts), "word " * r.randint(1, 90), " ".join(r.choice(vocabulary) for _ in range(6))]) for _ in range(r.randint(1, 14)))
        w = words(text)
        every = SCANNER.found(w, gated=False)
        assert SCANNER.found(w) == every
        kept = []
        for d in sorted(every, key=lambda d: (d[3], d[0] - d[1], d[0], d[2], -d[4])):
            if not any(k[0] <= d[0] and d[1] <= k[1] for k in kept):
                kept.append(d)
        assert SCANNER.detections(w) == sorted(kept)


def test_rules():
    assert len(SCANNER.rules) > 250 and len({r.pattern.pattern for r in SCANNER.rules}) == len(SCANNER.rules)
    for rule in SCANNER.rules:
        assert rule.keywords and 0 < rule.confidence <= 1


def test_long_text_full_of_notices():
    began = time.time()
    found = SCANNER.detections(words("the mit license stands here " * 180_000))
    assert len(found) == 180_000 and time.time() - began < 30
