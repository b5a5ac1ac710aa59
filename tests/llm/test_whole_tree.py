"""All exact contexts of the suffix tree, against a tree built word by word in plain Python."""

import math
import random
from collections import Counter, defaultdict

import pytest
from test_suffix_tree import Plain, corpus

from rankengine.llm import suffix_tree


class Whole(Plain):
    """Every run of up to `reach` words seen twice is a context, but those that are frequent as they are."""

    def frequent(self, texts):
        least, suffix_tree.LEAST_GAIN = suffix_tree.LEAST_GAIN, -math.inf
        try:
            self.hot = set(super().frequent(texts))
        finally:
            suffix_tree.LEAST_GAIN = least
        return super().frequent(texts)

    def chain(self, tokens, i):
        """The contexts of a place that aren't hot, shortest first."""
        out = []
        for k in range(1, min(self.reach, i) + 1):
            past = tuple(tokens[i - j] for j in range(1, k + 1))
            if self.c[past[-1]] < 2:
                break
            hot = all(w in self.own for w in past) and past in self.hot
            if out or not hot:
                out.append(past)
        return out

    def steps(self, tokens, i, w):
        p, out = self.short(tokens, i, w), []
        for past in self.chain(tokens, i):
            p = self.smooth(self.states[past], w, p) if past in self.states else p
            out.append((past, p))
        return out

    def longer(self, texts):
        seen, gain = defaultdict(Counter), Counter()
        for t in texts:
            for i, w in enumerate(t):
                for past in self.chain(t, i):
                    seen[past][w] += 1
        self.states = {c: (f.total(), {w: n for w, n in f.items() if n >= 2}) for c, f in seen.items()}
        for t in texts:
            for i, w in enumerate(t):
                p = self.short(t, i, w)
                for past, q in self.steps(t, i, w):
                    gain[past] += math.log(q / p)
                    p = q
        kept = {c for c in self.states if gain[c] >= suffix_tree.LEAST_GAIN + len(self.states[c][1])}
        return {c: self.states[c] for c in self.states if any(k[: len(c)] == c for k in kept)}

    def probability(self, tokens, i, w):
        p = self.short(tokens, i, w)
        for past, q in self.steps(tokens, i, w):
            p = q if past in self.exact else p
        return p


@pytest.mark.parametrize("reach,share", [(3, 0.02), (3, 1e-4), (1, 0.01)])
def test_scores_against_whole_tree(spark, monkeypatch, reach, share):
    monkeypatch.setattr(suffix_tree, "SYMBOL_SHARE", share)
    monkeypatch.setattr(suffix_tree, "CONTEXT_SHARE", 0.002)
    draw = random.Random(reach)
    said = [" ".join(draw.choice("ab of the cd e in to is at he".split()) for _ in range(12)) for _ in range(25)]
    rows = corpus(reach) + [(1000 + i, draw.choice(said), i % 3 > 0) for i in range(160)]
    plain = Whole(rows, reach, reach, None)
    assert any(len(c) == reach for c in plain.exact) and any(plain.c[c[-1]] > 32 for c in plain.exact)
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, train boolean")
    got = suffix_tree.score_texts(docs, reach=reach).collect()
    key = lambda x: (x[0] is None, x[0] or 0, x[1], round(x[2], 2))
    want = sorted(((a, not c, plain.score(b)) for a, b, c in rows), key=key)
    got = sorted(((r.doc_id, r.held_out, r.score) for r in got), key=key)
    assert [x[:2] for x in got] == [x[:2] for x in want]
    assert [x[2] for x in got] == pytest.approx([x[2] for x in want], abs=5e-4)


def test_contexts_of_common_words_are_learnt(spark):
    """A phrase whose words are each seen more than 32 times."""
    draw = random.Random(4)
    words = [f"w{i}" for i in range(300)]
    texts = [" ".join(draw.choice(words) for _ in range(60)) for _ in range(400)]
    texts = [t + " w1 w2 w3 w4 w5" if i % 40 == 0 else t for i, t in enumerate(texts)]
    docs = spark.createDataFrame([(i, t, True) for i, t in enumerate([*texts, "w1 w2 w3 w4 w5", "w1 w9 w3 w17 w5"])], "doc_id bigint, text string, train boolean")
    score = {r.doc_id: r.score for r in suffix_tree.score_texts(docs).where("doc_id >= 400").collect()}
    assert score[400] > score[401] + 3
