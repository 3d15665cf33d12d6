import random
import re

from tesselog.llm import sentences as S

SCHEMA = "doc_id bigint, text string, key string, i int, hash bigint"


def frame(spark, rows):
    return spark.createDataFrame([(d, t, "k", 1, 2) for d, t in rows], SCHEMA)


def split(text):
    return re.findall(S.PATTERN, text or "")


def by_hand(rows, run=3, least=100):
    """{doc: (sentences, shared, removed, shared chars, removed chars, text)} by a loop over all runs."""
    places = {}
    for d, t in rows:
        s = split(t)
        for i in range(len(s) - run + 1):
            part = "".join(s[i : i + run])
            if len(part) >= least:
                places.setdefault(part, []).append((d, i))
    shared, gone = {}, {}
    for at in places.values():
        if len({d for d, _ in at}) > 1:
            first = min(at)
            for d, i in at:
                for j in range(i, i + run):
                    shared.setdefault(d, set()).add(j)
                    if (d, i) != first:
                        gone.setdefault(d, set()).add(j)
    out = {}
    for d, t in rows:
        s, a, b = split(t), shared.get(d, set()), gone.get(d, set())
        out[d] = (len(s), len(a), len(b), sum(len(s[i]) for i in a), sum(len(s[i]) for i in b), "".join(x for i, x in enumerate(s) if i not in b) if b else t)
    return out


def result(df):
    return {r.doc_id: tuple(r)[1:] for r in df.collect()}


def test_equals_brute_force(spark):
    rng = random.Random(3)
    pool = [" ".join(rng.choice("alpha beta gamma delta epsilon zeta".split()) for _ in range(rng.randrange(3, 12))) + rng.choice([". ", "!\n", "? ", "。", ".\n\n"]) for _ in range(60)]
    rows = []
    for d in range(80):
        s = [rng.choice(pool) for _ in range(rng.randrange(0, 14))]
        if d % 3 == 0:
            k = rng.randrange(40)
            s[1:1] = pool[k : k + 5]
        rows.append((d, "".join(s)))
    want = by_hand(rows)
    assert result(S.without_repeats(frame(spark, rows))) == want
    assert sum(w[2] for w in want.values()) > 50


def test_odd_texts_and_copies(spark):
    long = "".join(f"This is sentence number {i} of a longer text. " for i in range(9))
    rows = [(1, long), (2, long), (3, None), (4, ""), (5, " \n\t"), (6, long * 2), (7, "no stop at all " * 20), (8, "x" * 300_000 + ". " + long)]
    assert result(S.without_repeats(frame(spark, rows))) == by_hand(rows)
    assert S.without_repeats(frame(spark, [])).count() == 0
    got = S.without_repeats(frame(spark, [(1, long), (1, long), (None, long)])).collect()
    assert [(r.doc_id, r.shared_sentences, r.text) for r in got] == [(1, 0, long)] * 2


def test_planted_spans_are_found_whole(spark):
    """Each of 40 passages of five sentences is planted into two documents: all are found, and taken from the later one alone."""
    own = lambda d, part: "".join(f"Document {d} says {part} thing {j} in words of its own. " for j in range(4))
    passage = lambda k: "".join(f"Passage {k} holds its sentence {j} word for word. " for j in range(5))
    rows = [(2 * k + s, own(2 * k + s, "one") + passage(k) + own(2 * k + s, "another")) for k in range(40) for s in (0, 1)]
    got = result(S.without_repeats(frame(spark, rows)))
    assert all(got[2 * k][1:3] == (5, 0) and got[2 * k + 1][1:3] == (5, 5) for k in range(40))
    assert all(got[2 * k + 1][5] == own(2 * k + 1, "one") + own(2 * k + 1, "another") for k in range(40))
