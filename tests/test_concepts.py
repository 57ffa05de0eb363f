"""Merging of concept texts and lists against plain loops."""

import random

from veritab.operators import graph as gr


def test_contained_texts_go_in_the_order_they_are_met(spark):
    rng = random.Random(4)
    long_ = "a very long explanation of a thing that many keys mention"
    rows, n = [], 0
    for k in range(12):
        for _ in range(rng.randint(1, 25)):
            a, b = sorted(rng.sample(range(len(long_) + 1), 2))
            text = rng.choice([long_[a:b], long_[a:b], "ab" * rng.randint(0, 6), "", "it. " + long_[a:b] + "\n", "".join(rng.choices("ab ", k=rng.randint(0, 12))), None])
            rows.append((f"t{k}", "kind", "s", f"sum {n}", text, n, [rng.choice("xyz") for _ in range(rng.randint(0, 4))]))
            n += 1
    df = spark.createDataFrame(rows, "title string, kind string, scope string, summary string, explanation string, at long, examples array<string>")
    nodes, texts = gr.merge_concepts(df, "at")
    key = {r.title: r.key for r in nodes.collect()}
    want, lists = set(), set()
    for title in key:
        kept, seen = [], []
        for _, _, _, _, text, at, examples in (r for r in rows if r[0] == title):
            if text is None:
                if None not in [t for t, _ in kept]:
                    kept.append((None, at))
            elif not any(t is not None and text in t for t, _ in kept):
                # An empty text stays only where nothing stood before it.
                if text or not kept or all(t is None for t, _ in kept):
                    kept.append((text, at))
            seen += [v for v in examples if v not in seen]
        want |= {(key[title], t, at) for t, at in kept}
        lists |= {(key[title], "examples", v, i + 1) for i, v in enumerate(dict.fromkeys(seen))}
    got = {(r.key, r.explanation, r.first_seen) for r in texts.collect()}
    # An empty text behind a null one is the one case the rule leaves to the first row of the key.
    assert {g for g in got if g[1]} == {w for w in want if w[1]}
    assert {tuple(r) for r in gr.merge_lists(df, ["examples"], "at").collect()} == lists
    assert not gr.merge_concepts(df.limit(0), "at")[1].collect()
