"""Scores of the suffix tree against a tree built word by word in plain Python."""

import math
import random
from collections import Counter, defaultdict

import pytest

from rankengine.llm import suffix_tree

END = object()


class Plain:
    def __init__(self, rows, depth, reach, rare):
        self.depth, self.reach, self.rare = depth, reach, rare
        texts = [self.tokens(t) for _, t, train in rows if train]
        self.c = Counter(w for t in texts for w in t)
        self.total = sum(self.c.values())
        least = max(suffix_tree.SYMBOL_SHARE * self.total, 1.0)
        self.own = {w for w in self.c if w is not END and self.c[w] >= least}
        self.class_n, self.class_v = Counter(), Counter()
        for w, n in self.c.items():
            if w is not END and w not in self.own:
                self.class_n[w[-2:]] += n
                self.class_v[w[-2:]] += 1
        for e in [e for e, n in self.class_n.items() if n < suffix_tree.SYMBOL_SHARE * self.total]:
            self.class_n[None] += self.class_n.pop(e)
            self.class_v[None] += self.class_v.pop(e)
        count = Counter({END: self.c[END], ("class", None): 0})
        for w, n in self.c.items():
            if w is not END:
                count[self.symbol(w)] += n
        for e in self.class_n:
            count[("class", e)] += 0
        self.root = {s: (n + 0.5) / (self.total + 0.5 * len(count)) for s, n in count.items()}
        self.tree = self.frequent(texts)
        self.exact = self.longer(texts)

    @staticmethod
    def tokens(text):
        words = (text or "").replace("\t", " ").replace("\n", " ").split(" ")
        return ["".join(x.lower() if x.isascii() else x for x in w) for w in words if w] + [END]

    def symbol(self, w):
        if w is END or w in self.own:
            return w
        return ("class", w[-2:] if w[-2:] in self.class_n else None)

    def within(self, w):
        if w is END or w in self.own:
            return 1.0
        e = self.symbol(w)[1]
        return (self.c[w] + 0.5) / (self.class_n[e] + 0.5 * (self.class_v[e] + 1))

    def past(self, tokens, i, k):
        """The k symbols before place i, nearest first; before a text's first word there are ends."""
        return tuple(self.symbol(tokens[i - j]) if i >= j else END for j in range(1, k + 1))

    def frequent(self, texts):
        tree = {}
        for k in range(1, self.depth + 1):
            seen = defaultdict(Counter)
            for t in texts:
                for i, w in enumerate(t):
                    past = self.past(t, i, k)
                    if k == 1 or past[:-1] in tree:
                        seen[past][self.symbol(w)] += 1
            for past, following in seen.items():
                if following.total() >= suffix_tree.CONTEXT_SHARE * self.total:
                    tree[past] = following.total(), {s: n for s, n in following.items() if n >= max(2, suffix_tree.EVENT_SHARE * self.total)}
        keep = set()
        for past, (_, events) in tree.items():
            gain = sum(n * math.log(self.after(tree, past, s, len(past)) / self.after(tree, past, s, len(past) - 1)) for s, n in events.items())
            if gain >= suffix_tree.LEAST_GAIN + len(events):
                keep |= {past[:j] for j in range(1, len(past) + 1)}
        return {past: x for past, x in tree.items() if past in keep}

    def after(self, tree, past, symbol, upto):
        p = self.root[symbol]
        for k in range(1, upto + 1):
            if past[:k] not in tree:
                break
            total, events = tree[past[:k]]
            p = (events.get(symbol, 0) + (total - sum(events.values()) + suffix_tree.PRIOR) * p) / (total + suffix_tree.PRIOR)
        return p

    def short(self, tokens, i, w):
        return self.after(self.tree, self.past(tokens, i, self.depth), self.symbol(w), self.depth) * self.within(w)

    def anchored(self, tokens, i):
        for k in range(1, min(self.reach, i) + 1):
            if 2 <= self.c[tokens[i - k]] <= self.rare:
                return tuple(tokens[i - k : i])
        return None

    def longer(self, texts):
        seen, places = defaultdict(Counter), defaultdict(list)
        for t in texts:
            for i, w in enumerate(t):
                context = self.anchored(t, i)
                if context:
                    seen[context][w] += 1
                    places[context].append((t, i))
        out = {}
        for context, following in seen.items():
            out[context] = following.total(), {w: n for w, n in following.items() if n >= 2}
            gain = sum(math.log(self.smooth(out[context], t[i], self.short(t, i, t[i])) / self.short(t, i, t[i])) for t, i in places[context])
            if gain < suffix_tree.LEAST_GAIN + len(out[context][1]):
                del out[context]
        return out

    @staticmethod
    def smooth(state, w, p):
        total, events = state
        return (events.get(w, 0) + (total - sum(events.values()) + suffix_tree.PRIOR) * p) / (total + suffix_tree.PRIOR)

    def probability(self, tokens, i, w):
        p, context = self.short(tokens, i, w), self.anchored(tokens, i)
        return self.smooth(self.exact[context], w, p) if context in self.exact else p

    def score(self, text):
        tokens = self.tokens(text)
        return sum(math.log10(self.probability(tokens, i, w)) for i, w in enumerate(tokens))


def corpus(seed):
    draw = random.Random(seed)
    letters = ["".join(draw.choice("abcdeé") for _ in range(draw.randint(2, 6))) for _ in range(900)]
    word = lambda: letters[min(int(draw.expovariate(0.008)), 899)]
    texts = [" ".join(word() for _ in range(draw.randint(0, 40))) for _ in range(120)]
    texts += texts[:30] + ["A\tb  " + t.upper() for t in texts[5:9]] + ["", None, "unseen words only zz"]
    return [(None if i % 50 == 49 else i // 2, t, i % 4 != 1) for i, t in enumerate(texts)]


@pytest.mark.parametrize("depth,reach,share", [(1, 3, 0.01), (2, 1, 0.02), (1, 0, 0.005), (2, 4, 1e-4)])
def test_scores_against_plain_tree(spark, monkeypatch, depth, reach, share):
    monkeypatch.setattr(suffix_tree, "SYMBOL_SHARE", share)
    rows = corpus(depth + reach)
    plain = Plain(rows, depth, reach, 12)
    docs = spark.createDataFrame([(a, b, c, "x", 1) for a, b, c in rows], "doc_id bigint, text string, train boolean, key string, more int")
    got = suffix_tree.score_texts(docs, depth, reach, 12).collect()
    key = lambda x: (x[0] is None, x[0] or 0, x[1], round(x[2], 3))
    want = sorted(((a, not c, plain.score(b)) for a, b, c in rows), key=key)
    got = sorted(((r.doc_id, r.held_out, r.score) for r in got), key=key)
    assert [x[:2] for x in got] == [x[:2] for x in want]
    assert [x[2] for x in got] == pytest.approx([x[2] for x in want], abs=1e-4)
    assert bool(plain.exact) == (reach > 0)
    for _, text, _ in rows[::7]:  # all words, an unknown one of each class and the end have probability 1 in all
        tokens = plain.tokens(text)
        unknown = ["?" + (e or "??") for e in plain.class_n if "?" + (e or "??") not in plain.c]
        for i in range(0, len(tokens), 5):
            mass = sum(plain.probability(tokens, i, w) for w in [*plain.c, *unknown])
            spare = sum(p for s, p in plain.root.items() if isinstance(s, tuple) and s[1] not in plain.class_n)
            assert mass <= 1 + 1e-9 and (mass == pytest.approx(1, abs=1e-6) or spare)


def test_copies_are_scored_apart_whatever_the_size(spark):
    """A rare passage seen twice is learned, however many other texts there are."""
    draw = random.Random(5)
    for n in (200, 2000):
        texts = [" ".join(f"w{min(int(draw.expovariate(0.004)), 3000)}" for _ in range(30)) for _ in range(n)]
        docs = spark.createDataFrame([(i, t, True) for i, t in enumerate([*texts, texts[0]])], "doc_id bigint, text string, train boolean")
        rows = {r.doc_id: (r.score - r.base_score) / r.n_tokens for r in suffix_tree.score_texts(docs).collect()}
        others = sorted(rows[i] for i in range(1, n))
        assert rows[0] == rows[n] and rows[0] > others[int(0.99 * len(others))]


def test_reruns_and_scattered_rows_agree(spark):
    rows = corpus(9)
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, train boolean")
    once = suffix_tree.score_texts(docs).collect()
    again = suffix_tree.score_texts(docs.repartition(7)).collect()
    assert sorted(map(str, once)) == sorted(map(str, again))


def test_blocks_of_neighbours(spark, monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(suffix_tree, "BLOCK_BYTES", 10)
    draw = random.Random(3)
    sizes = [draw.choice([0, 1, 4, 9, 35]) for _ in range(200)]
    rows = pa.table({"text": [None if n == 0 and i % 2 else "x" * n for i, n in enumerate(sizes)], "row": pa.array(range(7, 207), pa.int64())})
    got = [b for batch in suffix_tree._dealt(iter(rows.to_batches(max_chunksize=17))) for b in batch.column("block").to_pylist()]
    assert got == sorted(got) and got[0] == 7
    held = defaultdict(list)
    for b, n in zip(got, sizes, strict=True):
        held[b].append(n)
    assert all(sum(x[:-1]) < 20 for x in held.values()) and len(held) > 50
    assert list(suffix_tree._dealt(iter(rows.slice(0, 0).to_batches()))) == []
