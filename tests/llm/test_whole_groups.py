"""Groups of near fingerprints against all pairs."""

import random

import numpy as np
import pyarrow as pa
import pytest

from rankengine.llm import edit_prints


def _brute(prints, threshold):
    """The smallest number of each print's group, by all pairs."""
    group = list(range(len(prints)))
    for i, p in enumerate(prints):
        for j in range(i):
            q = prints[j]
            if p.last and q.last and edit_prints.likeness((np.array([p.last]), np.array([q.last])), ([p.strata], [q.strata]))[0] >= threshold:
                a, b = sorted((group[i], group[j]))
                group = [a if g == b else g for g in group]
    return group


@pytest.mark.parametrize("threshold,chunk", [(0.8, None), (0.6, 16)])
def test_all_near_texts_are_joined(spark, monkeypatch, threshold, chunk):
    if chunk:
        monkeypatch.setattr(edit_prints, "CHUNK_LEAST", chunk)
    rng = random.Random(8)
    word = lambda n: "".join(rng.choice("etaoin shrdlu") for _ in range(n))
    texts = [word(n) for n in (1, 1, 2, 3, 5, 9)]
    for n in (40, 260, 500, 520, 1100, 4000):
        begin, base = word(n // 2), word(n)
        texts += [begin + word(n // 2) for _ in range(4)]  # near in a lower stratum only
        for _ in range(8):  # each some edits from the one before, so that many are near each other and not the first
            texts.append(base)
            for _ in range(max(1, n // 100)):
                at = rng.randrange(len(base))
                base = base[:at] + word(rng.choice((0, 1, 2))) + base[at + 1 :]
            base += word(rng.choice((0, n // 12)))
    prints = edit_prints._prints(texts)
    want = _brute(prints, threshold)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    made = edit_prints.fingerprints(docs)
    groups = {r.fingerprint: r.group_id for r in edit_prints.near_groups(made, threshold).collect()}
    assert {r.doc_id: groups[r.fingerprint] for r in made.collect()} == dict(enumerate(want))
    assert len(set(want)) < len(want) - 20


def test_no_near_text_is_shorter_than_said():
    rng = random.Random(3)
    texts = ["".join(rng.choice("abcd ") for _ in range(rng.randint(1, 700))) for _ in range(150)]
    texts += [t[: rng.randint(1, len(t))] for t in texts]
    prints = edit_prints._prints(texts)
    ends, strata = np.array([p.last for p in prints]), [p.strata for p in prints]
    least = edit_prints.shortest(ends, pa.array([x.view(np.int64) for x in strata], pa.list_(pa.int64())), 0.8)
    assert (least <= ends).all() and (least > 0.4 * ends).mean() > 0.7
    for i in range(0, len(prints), 3):
        n = len(prints)
        alike = edit_prints.likeness((np.full(n, ends[i]), ends), ([strata[i]] * n, strata))
        assert (ends[(alike >= 0.8) & (ends <= ends[i])] >= least[i]).all()
