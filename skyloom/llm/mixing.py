"""Mixing sources to target weights by hierarchical budgeting.

Weights go down a tree of domains, languages and sources. A node whose documents can't fill its share, even at
``epochs`` passes over them, leaves the rest to its siblings by their weights; only what no sibling can take goes
to the siblings of its parent, and so on. Each leaf then takes the first tokens of its endless seeded stream: pass
after pass over its documents, each in another order by a hash of seed, pass and id.

Domains and languages are budgeted on the driver, a language's sources in a task of their own. Where a leaf's last
pass ends is found from token sums of 4096 ranges of the hash, then of 4096 parts of one range, then within one part,
so no leaf is sorted or gathered. The cut is a row a leaf, and choosing documents is a filter.

Defined results: a null domain, language, source or text is an empty one; a null id is hashed as ``null``. Tokens
are words between ASCII white space. Rows of a leaf with one id stand at the same place and are taken or left
together; the prefix ends before the place whose tokens exceed the budget. Without weights siblings share equally;
a weight of 0 takes nothing.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import sized, stored

#: Hexadecimal digits of the hash by which ranges are told, and how often.
DIGITS, LEVELS = 3, 2
KEYS = ["_domain", "_lang", "_source"]


@dataclass(frozen=True)
class Mix:
    """share: part of all tokens to take. epochs: most passes over a leaf. weights: by path, ``("web",)``,
    ``("web", "en")`` or ``("web", "en", "src0")``, with ``None`` standing for any name; others weigh 1."""

    share: float = 0.6
    epochs: int = 2
    seed: int = 7
    domains: dict[str, str] = field(default_factory=dict)
    weights: dict[tuple, float] = field(default_factory=dict)

    def weight(self, path: tuple[str, ...]) -> float:
        names = [self.weights[k] for k in self.weights if len(k) == len(path) and all(a is None or a == b for a, b in zip(k, path, strict=True))]
        exact = self.weights.get(path)
        return float(exact if exact is not None else names[0] if names else 1.0)


def shares(budget: int, weights: list[float], room: list[int]) -> list[int]:
    """Parts of a budget by weight, none over its room; what is over goes to the others by weight. Whole numbers, all of
    the budget that there is room for."""
    given = [0] * len(room)
    open_ = [i for i, w in enumerate(weights) if w > 0 and room[i] > 0]
    left = min(budget, sum(room[i] for i in open_))
    while open_ and left > 0:
        total = sum(weights[i] for i in open_)
        full = [i for i in open_ if room[i] <= left * weights[i] / total]
        if not full:
            exact = [left * weights[i] / total for i in open_]
            parts = [int(x) for x in exact]
            for k in sorted(range(len(open_)), key=lambda k: (parts[k] - exact[k], k))[:left - sum(parts)]:
                parts[k] += 1
            for i, p in zip(open_, parts, strict=True):
                given[i] = min(p, room[i])
            break
        for i in full:
            given[i] = room[i]
        left -= sum(room[i] for i in full)
        gone = set(full)
        open_ = [i for i in open_ if i not in gone]
    return given


def budgets(tokens: dict[tuple[str, ...], int], total: int, mix: Mix) -> dict[tuple[str, ...], int]:
    """Each leaf's tokens to take, of those it has. Each level's leaves are parted once, so the work grows with leaves times depth."""
    depth = len(next(iter(tokens), ()))
    #: What a subtree can take: nothing below a weight of 0. A leaf's weight is judged at each of its levels.
    room: dict[tuple[str, ...], int] = {}
    children: dict[tuple[str, ...], list[tuple[str, ...]]] = {}
    for leaf in sorted(tokens):
        fits = all(mix.weight(leaf[:k]) > 0 for k in range(1, depth + 1))
        for k in range(depth + 1):
            node = leaf[:k]
            if node not in room:
                room[node] = 0
                if k:
                    children.setdefault(leaf[:k - 1], []).append(node)
            # Below a node only the levels under it count; a weight of 0 above it leaves it no budget anyway.
            room[node] += tokens[leaf] * mix.epochs if fits or all(mix.weight(leaf[:j]) > 0 for j in range(k + 1, depth + 1)) else 0
    given = {(): total} if tokens else {}
    for node in sorted(children, key=len):
        parts = shares(given[node], [mix.weight(c) for c in children[node]], [room[c] for c in children[node]])
        given |= dict(zip(children[node], parts, strict=True))
    return {leaf: given[leaf] for leaf in tokens}


def with_leaf(docs: DataFrame, mix: Mix, lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """Adds ``_domain, _lang, _source``."""
    source = F.coalesce(F.col(source_col).cast("string"), F.lit(""))
    domain = F.lit("")
    for name in sorted(set(mix.domains.values())):
        domain = F.when(source.isin([s for s, d in mix.domains.items() if d == name]), F.lit(name)).otherwise(domain)
    return docs.withColumns({"_domain": domain, "_lang": F.coalesce(F.col(lang_col).cast("string"), F.lit("")), "_source": source})


def place(seed: int, epoch: Column, doc_id: Column) -> Column:
    """Where a document stands in a pass."""
    return F.md5(F.concat(F.lit(f"{seed}:"), epoch.cast("string"), F.lit(":"), F.coalesce(doc_id.cast("string"), F.lit("null"))))


def word_count(text: Column) -> Column:
    return F.size(F.array_remove(F.split(F.coalesce(text.cast("string"), F.lit("")), r"[\x20\x09-\x0D]+"), "")).cast("long")


def _weight(mix: Mix) -> Column:
    """A leaf's weight among its siblings."""
    out = F.lit(1.0)
    whole = {k: w for k, w in mix.weights.items() if len(k) == len(KEYS)}
    for path, w in [*reversed([x for x in whole.items() if None in x[0]]), *(x for x in whole.items() if None not in x[0])]:
        fits = F.lit(True)
        for name, part in zip(KEYS, path, strict=True):
            fits = fits & (F.lit(True) if part is None else F.col(name) == part)
        out = F.when(fits, F.lit(float(w))).otherwise(out)
    return out


def leaf_budgets(counted: DataFrame, mix: Mix) -> DataFrame:
    """``_domain, _lang, _source, n, budget``: the tokens that each leaf has and is to give. The driver sees a row a domain and
    language; each language's sources are shared out in one task, a few bytes each."""
    leaves = stored(counted.groupBy(*KEYS).agg(F.sum("n_tokens").alias("n")).withColumn("weight", _weight(mix)), "mix-leaves")
    nodes = leaves.groupBy("_domain", "_lang").agg(F.sum("n").alias("n"), F.sum(F.when(F.col("weight") > 0, F.col("n")).otherwise(0)).alias("usable")).collect()
    plan = budgets({(r["_domain"], r["_lang"]): int(r["usable"]) for r in nodes}, int(sum(r["n"] for r in nodes) * mix.share), mix)
    table = leaves.sparkSession.createDataFrame([(*k, b) for k, b in sorted(plan.items())], "_domain string, _lang string, given long")

    def parted(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("_source")
        room = [int(n) * mix.epochs for n in frame["n"]]
        return frame[[*KEYS, "n"]].assign(budget=shares(int(frame["given"].iloc[0]), frame["weight"].tolist(), room))

    return leaves.join(sized(table), ["_domain", "_lang"]).groupBy("_domain", "_lang").applyInPandas(parted, "_domain string, _lang string, _source string, n long, budget long")


def cuts(counted: DataFrame, mix: Mix) -> DataFrame:
    """A row a leaf: full passes, and the place up to which the next pass is taken. ``counted``: _domain, _lang, _source, doc_id, n_tokens."""
    some = F.col("n") > 0
    table = stored(leaf_budgets(counted, mix).select(*KEYS, F.when(some, F.expr("try_divide(budget - budget % greatest(n, 1), n)")).otherwise(0).cast("long").alias("_full"), F.when(some, F.expr("budget % greatest(n, 1)")).otherwise(0).alias("_rest"), F.col("budget").alias("_budget")), "mix-leaf-budgets")
    placed = counted.join(sized(table.where("_rest > 0").drop("_budget")), KEYS).withColumn("p", place(mix.seed, F.col("_full"), F.col("doc_id")))
    # The range in which the budget ends, then the part of it; all before it are taken.
    edge = table.where("_rest > 0").select(*KEYS, F.lit("").alias("_range"), F.lit(0).cast("long").alias("_before"))
    for level in range(LEVELS):
        inside = placed.join(sized(edge), KEYS).where(F.substring("p", 1, DIGITS * level) == F.col("_range")) if level else placed.withColumns({"_range": F.lit(""), "_before": F.lit(0).cast("long")})
        summed = inside.groupBy(*KEYS, "_rest", "_range", "_before", F.substring("p", DIGITS * level + 1, DIGITS).alias("b")).agg(F.sum("n_tokens").alias("n"))
        end = F.col("_before") + F.sum("n").over(Window.partitionBy(*KEYS).orderBy("b"))  # 4096 rows a leaf at most
        ended = summed.withColumn("end", end).where("end - n <= _rest and end > _rest")
        edge = stored(ended.groupBy(*KEYS).agg(F.min(F.struct("b", F.concat("_range", "b").alias("r"), (F.col("end") - F.col("n")).alias("e"))).alias("m")).select(*KEYS, F.col("m.r").alias("_range"), F.col("m.e").alias("_before")), "mix-edge")
    last = placed.join(sized(edge), KEYS).where(F.substring("p", 1, DIGITS * LEVELS) == F.col("_range")).groupBy(*KEYS, "p", "_before", "_rest").agg(F.sum("n_tokens").alias("n"))
    upto = last.withColumn("end", F.col("_before") + F.sum("n").over(Window.partitionBy(*KEYS).orderBy("p"))).where("end <= _rest").groupBy(*KEYS).agg(F.max("p").alias("_place"))
    return table.join(edge.drop("_before"), KEYS, "left").join(stored(upto, "mix-cut"), KEYS, "left")


def mixed(docs: DataFrame, mix: Mix, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source", copies: str = "copies") -> DataFrame:
    """The taken rows with all their columns and how many times each is taken, in a column ``copies``, to which an input column
    of that name gives way. Input columns may have any names: they travel as one value."""
    own = lambda c: f"_doc.`{c}`"
    named = with_leaf(docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_doc")), mix, own(lang_col), own(source_col))
    counted = stored(named.select(*KEYS, F.col(own(id_col)).cast("long").alias("doc_id"), word_count(F.col(own(text_col))).alias("n_tokens")), "mix-counted")
    taken = chosen(named, cuts(counted, mix), mix, own(id_col))
    return taken.select(*(F.col(own(c)).alias(c) for c in docs.columns if c != copies), F.col("copies").alias(copies))


def chosen(named: DataFrame, table: DataFrame, mix: Mix, id_col: str) -> DataFrame:
    out = named.join(sized(stored(table, "mix-table")), KEYS)
    p = place(mix.seed, F.col("_full"), F.col(id_col))
    part = (F.col("_rest") > 0) & ((F.substring(p, 1, DIGITS * LEVELS) < F.col("_range")) | (p <= F.col("_place")))
    copies = F.when(F.col("_budget") > 0, F.col("_full") + F.when(part, 1).otherwise(0)).otherwise(0)
    return out.withColumn("copies", copies).where("copies > 0").drop("_full", "_rest", "_budget", "_range", "_place")


def digest(docs: DataFrame, mix: Mix) -> DataFrame:
    """``doc_id, domain, lang, source, n_tokens, copies`` of the taken documents, from one reading of the texts."""
    named = with_leaf(docs, mix)
    counted = stored(named.select(*KEYS, F.col("doc_id").cast("long").alias("doc_id"), word_count(F.col("text")).alias("n_tokens")), "mix-counted")
    return chosen(counted, cuts(counted, mix), mix, "doc_id").select("doc_id", F.col("_domain").alias("domain"), F.col("_lang").alias("lang"), F.col("_source").alias("source"), "n_tokens", "copies")


#: The mix of the registered query and of the pipeline.
STANDARD = Mix(
    share=0.8, epochs=2, seed=7,
    domains={f"src{i}": ("web", "books", "reference", "forum")[i // 5] for i in range(20)},
    weights={("web",): 0.4, ("books",): 0.25, ("reference",): 0.25, ("forum",): 0.1, (None, "en"): 3.0},
)
