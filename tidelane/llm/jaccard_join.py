"""Jaccard self-join of documents' word n-gram sets with prefix filters under several global orders.

Two sets that are alike enough share tokens among the first of each, under any order of all tokens:
as many as their intersection must have beyond what the rest of either set can hold. The first
order puts rare tokens first, by their exact counts over the corpus; the others are hashes that
know nothing of the counts, so that each order is a filter of its own. Pairs that share a prefix
token under the first order are counted out under every order, on the prefixes alone; the whole
sets are fetched for the pairs that pass all of them, and only these are verified.

A shared token that comes late in an order leaves too few tokens after it for a pair that shares
none before it, so a pair must meet at a token with room enough on both sides.

Frequent tokens do not multiply pairs: a group of documents that share a prefix token is first
tied to its least and greatest member; only where verified links leave a group in several
components are the remaining pairs, those across components, looked at. So no component is torn, and a
group of near copies costs a few pairs a member. The verified links are a spanning subset of all
links: other pairs within a component may be linked, too, and are not verified or returned.

Defined results: texts without words, null texts included, have the empty set and link with
nothing; equal texts are one class and share its component; a text of any length is taken whole, by
one task; rows without a doc_id are left out; of rows that repeat a doc_id the text with the least
hashes counts; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelane.llm.common import U64, arrow_table, batch, bounded, given_back, hashed, mixed, part_of, shingles
from tidelane.llm.copies import first_copies, first_texts, keyed
from tidelane.llm.dealing import PART_BYTES, dealt, n_parts, text_bytes
from tidelane.llm.exchange import ANSWER_DDL, SENT_DDL, answered, cut, looked_up, received, sent
from tidelane.operators.components import connected_components
from tidelane.operators.materialise import saved

SHINGLE_WORDS = 5
THRESHOLD = 75
#: Seeds of the orders' hashes. The first order goes by counts and breaks ties by its hash; the others go by theirs.
ORDERS = (0x1F83D9AB, 0x5BE0CD19, 0x243F6A88)
_PREFIXES = [(f"prefix_{k}", pa.list_(pa.int64())) for k in range(len(ORDERS))]
UNITS = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("single", pa.int64()), *_PREFIXES, ("tokens", pa.binary())])
UNITS_DDL = f"doc_id long, n long, single long, {', '.join(f'{name} array<long>' for name, _ in _PREFIXES)}, tokens binary"


def prefix_length(n: int, threshold: int = THRESHOLD) -> int:
    """Tokens of which one at least is shared by any set that is alike enough: n - ceil(n * threshold / 100) + 1."""
    return n - -(-n * threshold // 100) + 1


def prefixes(tokens: np.ndarray, counts: np.ndarray, threshold: int = THRESHOLD) -> list[np.ndarray] | None:
    """The prefix under each order, less the tokens of a single document (count 0 or 1); None if the first has nothing left."""
    shared = counts >= 2
    n = prefix_length(len(tokens), threshold)
    if n <= int((~shared).sum()):
        return None
    by_count, *by_hash = (mixed(tokens ^ U64(seed)) for seed in ORDERS)
    orders = [np.lexsort((by_count, np.maximum(counts, 1))), *(np.argsort(h) for h in by_hash)]
    return [tokens[k[:n][shared[k[:n]]]] for k in orders]


def _sets(table: pa.Table, firsts: pa.Table, size: int) -> Iterator[tuple[int, np.ndarray]]:
    """doc_id and token set of each first copy in a part."""
    for ids, texts in first_texts(table["packed"].to_pylist(), firsts):
        ids = ids.to_pylist()
        for first, words, at in hashed(texts):
            for k in range(len(at) - 1):
                yield ids[first + k], shingles(words[at[k] : at[k + 1]], size)


def token_sets(docs: DataFrame, firsts: DataFrame, size: int, threshold: int) -> DataFrame:
    """doc_id, n, single (tokens no other text has), prefix_0..., tokens of each first copy; the last ones only of those that may link."""
    text_size = text_bytes(docs)
    parts, n_buckets = n_parts(text_size, docs), n_parts(text_size, docs, 2 * PART_BYTES)
    dealt_docs = dealt(docs.select("doc_id", "h", "text"), part_of(parts, "doc_id")).repartition(parts, "part")
    wanted = firsts.filter("doc_id = first_id").select(part_of(parts, "doc_id").alias("part"), "doc_id", "h", "first_id")

    @given_back
    def send(key, table, firsts):
        sets = [cut(s) for _, s in _sets(table, firsts, size)]
        tokens, counts = np.unique(np.concatenate([np.zeros(0, U64), *sets]), return_counts=True)
        return sent(key[0].as_py(), tokens, counts, n_buckets)

    @given_back
    def use(key, table, answers):
        firsts = answers.filter(answers["payload"].is_null())
        df = received(answers["payload"].to_pylist())
        out = {name: [] for name in UNITS.names}
        for doc_id, tokens in _sets(table, firsts, size):
            counts = looked_up(cut(tokens), df)
            found = prefixes(tokens, counts, threshold)
            out["doc_id"].append(doc_id)
            out["single"].append(int((counts < 2).sum()))
            out["n"].append(len(tokens))
            for k in range(len(ORDERS)):
                out[f"prefix_{k}"].append(None if found is None else found[k].view(np.int64))
            out["tokens"].append(None if found is None else tokens.tobytes())
        return arrow_table(UNITS, **out)

    sent_rows = dealt_docs.groupBy("part").cogroup(wanted.groupBy("part")).applyInArrow(send, SENT_DDL)
    nulls = [f"CAST(NULL AS LONG) AS {c}" for c in ("doc_id", "h", "first_id")]
    answers = answered(sent_rows, 2).selectExpr("part", "payload", *nulls)
    answers = answers.unionByName(wanted.selectExpr("part", "CAST(NULL AS BINARY) AS payload", "doc_id", "h", "first_id"))
    return saved(dealt_docs.groupBy("part").cogroup(answers.groupBy("part")).applyInArrow(use, UNITS_DDL))


def candidates(pairs: DataFrame, units: DataFrame, threshold: int) -> DataFrame:
    """a, b and, for each order, passes_k: whether the prefixes share as many tokens as the pair needs."""
    p = "n - ceil(n * {t} / 100) + 1".format(t=threshold)  # prefix_length()
    sides = [units.filter("tokens IS NOT NULL").selectExpr(f"doc_id AS {s}", f"n AS n_{s}", f"{p} AS p_{s}", *(f"prefix_{k} AS prefix_{k}_{s}" for k in range(len(ORDERS)))) for s in "ab"]
    both = pairs.join(sides[0], "a").join(sides[1], "b")
    needed = F.ceil((F.col("n_a") + F.col("n_b")) * threshold / F.lit(100 + threshold)) - F.greatest(F.col("n_a") - F.col("p_a"), F.col("n_b") - F.col("p_b"))
    passes = [(F.size(F.array_intersect(f"prefix_{k}_a", f"prefix_{k}_b")) >= F.greatest(needed, F.lit(1))).alias(f"passes_{k}") for k in range(len(ORDERS))]
    return both.select("a", "b", *passes)


def verified(pairs: DataFrame, units: DataFrame, threshold: int) -> DataFrame:
    """The pairs (a, b) whose sets are alike enough, with the sizes of intersection and union."""
    left = saved(candidates(pairs, units, threshold).filter(" AND ".join(f"passes_{k}" for k in range(len(ORDERS)))).select("a", "b"))
    sets = [units.filter("tokens IS NOT NULL").selectExpr(f"doc_id AS {s}", f"tokens AS set_{s}") for s in "ab"]
    both = left.join(sets[0], "a").join(sets[1], "b").select("a", "b", "set_a", "set_b")

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("shared", pa.int64()), ("together", pa.int64())])
        for rows in batches:
            out = {name: [] for name in schema.names}
            for a, b, x, y in zip(rows["a"].to_pylist(), rows["b"].to_pylist(), rows["set_a"], rows["set_b"]):
                x, y = np.frombuffer(x.as_buffer(), U64), np.frombuffer(y.as_buffer(), U64)
                all_ = np.concatenate([x, y])
                all_.sort()
                shared = int((all_[1:] == all_[:-1]).sum())
                if 100 * shared >= threshold * (len(all_) - shared):
                    for name, value in zip(schema.names, (a, b, shared, len(all_) - shared)):
                        out[name].append(value)
            yield batch(schema, **out)

    return bounded(both).mapInArrow(check, "a long, b long, shared long, together long")


def _fits(a: str, b: str, threshold: int):
    """Sizes so different that no overlap would do are left out."""
    return F.least(a, b) * 100 >= F.greatest(a, b) * threshold


def links(units: DataFrame, threshold: int = THRESHOLD) -> tuple[DataFrame, DataFrame]:
    """Links (a, b, shared, together) between different texts that hold every component together, and doc_id, component."""
    placed = units.filter("tokens IS NOT NULL").select("doc_id", "n", "single", F.posexplode("prefix_0").alias("place", "token"))
    prefix = saved(placed.select("doc_id", "n", "token", (F.col("n") - F.col("single") - F.col("place")).alias("reach")))
    ends = prefix.groupBy("token").agg(F.min(F.struct("doc_id", "n")).alias("lo"), F.max(F.struct("doc_id", "n")).alias("hi")).filter("lo.doc_id <> hi.doc_id")
    tied = prefix.join(ends, "token").select("doc_id", "n", F.explode(F.array("lo", "hi")).alias("end")).filter("doc_id <> end.doc_id")
    tied = tied.filter(_fits("n", "end.n", threshold)).select(F.least("doc_id", "end.doc_id").alias("a"), F.greatest("doc_id", "end.doc_id").alias("b")).distinct()
    first = saved(verified(tied, units, threshold))
    joined = connected_components(first.select(F.col("a").alias("src"), F.col("b").alias("dst")))

    marked = saved(prefix.join(joined.withColumnRenamed("node", "doc_id"), "doc_id", "left").withColumn("component", F.coalesce("component", "doc_id")))
    split = marked.groupBy("token").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).filter("lo <> hi").select("token")
    open_ = marked.join(split, "token").withColumn("most", F.floor(F.col("reach") * (100 + threshold) / threshold) - F.col("n"))
    # What the parts of a group allow: sizes, and the largest partner that the rest of the order leaves room for.
    room = open_.groupBy("token", "component").agg(F.count("*").alias("members"), F.min("n").alias("least"), F.max("n").alias("largest"), F.max("most").alias("most"))
    x, y = (room.select("token", *[F.col(c).alias(f"{c}_{side}") for c in ("component", "members", "least", "largest", "most")]).alias(side) for side in "xy")
    fits = (F.col("least_y") <= F.col("most_x")) & (F.col("least_x") <= F.col("most_y")) & (F.col("largest_y") * 100 >= F.col("least_x") * threshold) & (F.col("largest_x") * 100 >= F.col("least_y") * threshold)
    smaller_first = F.struct("members_x", "component_x") < F.struct("members_y", "component_y")
    across = x.join(y, (F.col("x.token") == F.col("y.token")) & smaller_first & fits).select("x.token", "component_x", "component_y")
    left, right = (open_.select("token", *[F.col(c).alias(f"{c}_{side}") for c in ("component", "doc_id", "n", "most")]) for side in "xy")
    near = (F.col("n_y") <= F.col("most_x")) & (F.col("n_x") <= F.col("most_y")) & _fits("n_x", "n_y", threshold)
    half = across.join(left, ["token", "component_x"]).alias("l")
    met = half.join(right.alias("r"), (F.col("l.token") == F.col("r.token")) & (F.col("l.component_y") == F.col("r.component_y")) & near)
    pairs = met.select(F.least("doc_id_x", "doc_id_y").alias("a"), F.greatest("doc_id_x", "doc_id_y").alias("b")).distinct().join(tied, ["a", "b"], "left_anti")
    second = saved(verified(pairs, units, threshold))
    all_links = first.unionByName(second)
    if second.isEmpty():
        return all_links, joined.withColumnRenamed("node", "doc_id")
    return all_links, connected_components(all_links.select(F.col("a").alias("src"), F.col("b").alias("dst"))).withColumnRenamed("node", "doc_id")


def similar_documents(documents: DataFrame, *, size: int = SHINGLE_WORDS, threshold: int = THRESHOLD) -> DataFrame:
    """doc_id, n_shingles, component_id and first_id (the least doc_id with the same text) of every document."""
    docs = keyed(documents)
    firsts = first_copies(docs)
    units = token_sets(docs, firsts, size, threshold)
    _, component = links(units, threshold)
    # Written before the join with all documents, so that a text with very many copies is a skewed key that Spark can split.
    known = saved(units.select(F.col("doc_id").alias("first_id"), F.col("n").alias("n_shingles")).join(component.withColumnRenamed("doc_id", "first_id"), "first_id", "left"))
    rows = firsts.select("doc_id", "first_id").join(known, "first_id")
    alone = F.when(F.col("n_shingles") == 0, F.col("doc_id")).otherwise(F.coalesce("component", "first_id"))
    return rows.select("doc_id", "n_shingles", alone.alias("component_id"), "first_id")


def one_of_each(documents: DataFrame, **options) -> DataFrame:
    """The documents, as they are, without those that reach a smaller doc_id by links. Rows without a doc_id stay."""
    classes = similar_documents(documents, **options)
    gone = saved(classes.filter("component_id <> doc_id").select(F.col("doc_id").alias("gone")))
    return documents.alias("d").join(gone.alias("g"), F.col("d.doc_id") == F.col("g.gone"), "left_anti")
