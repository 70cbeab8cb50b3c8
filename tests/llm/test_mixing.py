import hashlib
from collections import defaultdict

from pyspark.sql import functions as F

from skyloom.llm import mixing


def test_shares():
    assert mixing.shares(10, [1, 1], [100, 100]) == [5, 5]
    assert mixing.shares(10, [1, 1, 2], [1, 100, 100]) == [1, 3, 6]
    assert mixing.shares(10, [1, 1], [2, 3]) == [2, 3]
    assert mixing.shares(10, [0, 1], [50, 4]) == [0, 4]
    assert mixing.shares(7, [1, 1, 1], [9, 9, 9]) == [3, 2, 2]


def test_siblings_before_ancestors():
    tokens = {("a", "en", "x"): 10, ("a", "en", "y"): 1000, ("a", "fr", "x"): 1000, ("b", "en", "x"): 1000}
    got = mixing.budgets(tokens, 800, mixing.Mix(epochs=1))
    assert got == {("a", "en", "x"): 10, ("a", "en", "y"): 190, ("a", "fr", "x"): 200, ("b", "en", "x"): 400}
    got = mixing.budgets({**tokens, ("a", "en", "y"): 20}, 800, mixing.Mix(epochs=1))
    assert got == {("a", "en", "x"): 10, ("a", "en", "y"): 20, ("a", "fr", "x"): 370, ("b", "en", "x"): 400}
    got = mixing.budgets({("a", "en", "x"): 10, ("a", "fr", "x"): 20, ("b", "en", "x"): 1000}, 800, mixing.Mix(epochs=2))
    assert got == {("a", "en", "x"): 20, ("a", "fr", "x"): 40, ("b", "en", "x"): 740}


def brute(rows, mix):
    leaves = defaultdict(lambda: defaultdict(int))
    for doc_id, text, lang, source in rows:
        leaf = (mix.domains.get(source, ""), lang or "", source or "")
        leaves[leaf][doc_id] += len([w for w in (text or "").replace("\n", " ").split(" ") if w])
    tokens = {k: sum(v.values()) for k, v in leaves.items()}
    out = {}
    for leaf, budget in mixing.budgets(tokens, int(sum(tokens.values()) * mix.share), mix).items():
        if not budget:
            continue
        full, rest = divmod(budget, tokens[leaf])
        key = lambda d: hashlib.md5(f"{mix.seed}:{full}:{'null' if d is None else d}".encode()).hexdigest()  # noqa: B023, E731
        at, open_ = 0, rest > 0
        for d in sorted(leaves[leaf], key=key):
            at += leaves[leaf][d]
            open_ = open_ and at <= rest
            if full + open_:
                out[leaf, d] = full + open_
    return out, tokens


def test_selection(spark):
    rows = [(i, "w " * (i * 7919 % 90) + "\nx", ("en", "fr", None)[i % 3], f"src{i % 5 if i % 3 else 0}") for i in range(3000)]
    rows += [(5, "w w", "en", "src0")] * 3 + [(None, "a b c", "en", None), (7000, None, "en", "src0"), (7001, "long " * 50000, "de", "src1")]
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, lang string, source string, copies int").repartition(6)
    for mix in (mixing.STANDARD, mixing.Mix(share=1.5, epochs=3, seed=1), mixing.Mix(share=0.2, weights={("",): 0.0}, domains={"src1": "one"})):
        want, tokens = brute(rows, mix)
        got = mixing.digest(df.drop("copies"), mix).collect()
        assert {((r.domain, r.lang, r.source), r.doc_id): r.copies for r in got} == want
        kept = mixing.mixed(df.drop("copies"), mix)
        assert kept.columns == ["doc_id", "text", "lang", "source", "copies"] and kept.count() == len(got)
    # Names that the operator uses itself.
    odd = df.withColumns({"copies": F.lit(99), "_rest": F.lit("r"), "_domain": F.lit("d"), "_place": F.lit(1), "n_tokens": F.lit(-1)})
    kept = mixing.mixed(odd, mixing.STANDARD, copies="times")
    assert kept.columns == [*odd.columns, "times"]
    plain = sorted((str(r.doc_id), r.copies) for r in mixing.mixed(df.drop("copies"), mixing.STANDARD).collect())
    assert sorted((str(r.doc_id), r.times) for r in kept.collect()) == plain
    assert kept.where("copies <> 99 or _rest <> 'r' or _domain <> 'd' or _place <> 1 or n_tokens <> -1").count() == 0
    assert sorted((str(r.doc_id), r.copies) for r in mixing.mixed(odd, mixing.STANDARD).collect()) == plain
    assert mixing.digest(df.limit(0), mixing.STANDARD).collect() == []
