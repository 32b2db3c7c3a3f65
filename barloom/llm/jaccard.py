"""N-gram Jaccard self-join by token groups, and the classes it connects.

Texts become sets of hashed word shingles. Equal sets are one class from the
start. Two different sets with a similarity of at least t share one of their
first (1 - t) * n + 1 tokens in any fixed order; the order puts tokens last that
a sample of the texts shows to be frequent, so common lines and phrases rarely
count. Every token's documents of like size gather behind a leader, the one with the
fewest rare tokens, and documents with the same leader are a group.

Before any set is sent, a group's members compare small histograms of their
token hashes, which bound the overlap of two sets from above; a member that
reaches the threshold with no other leaves the group.

In a group, members similar to the leader are linked to it: that is one link
each, not one a pair, and settles that they are connected. Only the rest are
queries against the group: the union of the group's tokens bounds the overlap
that a query can have with any member, and the group is opened (overlaps counted
over the token lists) for queries that reach the bound. Every pair that shares
a prefix token is thereby linked, connected already, or shown to be unlinked.

A group over ``CHUNK_TOKENS`` or ``CHUNK_MEMBERS`` is split into chunks; its queries then go to every
chunk whose token union they can match, in blocks. Classes are the connected
components of the links, found by repeated contraction with written tables.

Tokens are 64-bit hashes; two different shingles of a pair of texts with equal
hashes would be needed for a wrong count.

Edge cases: null texts and texts without words have empty sets and are linked
with nothing; with fewer words than a shingle the whole sequence is one; rows
with equal id and text are one set; of an id with several texts each row has its
own set, each set is searched for, and links are by id; an empty table gives no
rows; a very long text is one set, whole; other columns may have any name.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import WordHashes, kept, materialize, small_batches, table

#: Tokens that are ordered last, at most: those that the sample holds most often.
FREQUENT = 200_000
#: One text in so many is counted for the order. The order decides speed only.
SAMPLE_EVERY = 16
#: Tokens of a chunk of a group.
CHUNK_TOKENS = 4_000_000
#: Members of a chunk: comparing their histograms may take the square of it.
CHUNK_MEMBERS = 8_000
#: The places of documents in groups are broadcast to the scan of the texts up to this many bytes.
BROADCAST_BYTES = 40_000_000

_B = np.uint64(0x9E3779B97F4A7C15)


def shingles(text: str | None, n: int, words: dict) -> np.ndarray:
    """Distinct shingle hashes of a text, ascending."""
    # bytes lower-case A-Z alone and split at \x20 and \x09-\x0D alone
    found = text.encode("utf-8", "surrogatepass").lower().split() if isinstance(text, str) else []
    if not found:
        return np.empty(0, np.int64)
    h = np.fromiter(map(words.__getitem__, found), np.uint64, len(found))
    width = min(n, len(h))
    out = np.full(len(h) - width + 1, width, np.uint64)
    for i in range(width):
        out = (out ^ (out >> np.uint64(29))) * _B + h[i : len(h) - width + 1 + i]
    out = (out ^ (out >> np.uint64(32))) * _B
    return np.unique((out ^ (out >> np.uint64(32))).view(np.int64))


def similar(inter, total, percent: int):
    """100 * intersection >= percent * union, for set sizes that add up to ``total``."""
    return 100 * inter >= percent * (total - inter)


def histogram(s: np.ndarray) -> np.ndarray:
    """Counts of the tokens by their low bits, about eight a bin."""
    bins = max(64, 1 << max(len(s) // 8, 1).bit_length())
    return np.bincount(s & (bins - 1), minlength=bins).astype(np.uint16 if len(s) < 65536 else np.uint32)


def _folded(raw: bytes, n: int, bins: int) -> np.ndarray:
    h = np.frombuffer(raw, np.uint16 if n < 65536 else np.uint32).astype(np.int32)
    while len(h) > bins:
        h = h[: len(h) // 2] + h[len(h) // 2 :]
    return h


def alive(sizes: list[int], histograms: list[bytes], percent: int) -> np.ndarray:
    """Which members can reach the threshold with another member; the leader is the first."""
    sizes = np.array(sizes, np.int64)
    bins = min(len(h) // (2 if n < 65536 else 4) for h, n in zip(histograms, sizes))
    table_ = np.stack([_folded(h, n, bins) for h, n in zip(histograms, sizes)])
    out = np.zeros(len(sizes), bool)

    def partners(i):
        hits = similar(np.minimum(table_, table_[i]).sum(1), sizes + sizes[i], percent)
        hits[i] = False
        return hits

    for i in range(len(sizes)):
        if not out[i] and (hits := partners(i)).any():
            out |= hits
            out[i] = True
    return out


def _frequent(slim: DataFrame, n: int) -> np.ndarray:
    """Tokens that the sampled texts share, the most frequent last."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words = kept("words", "hashes", WordHashes)
        for b in batches:
            own = [shingles(t, n, words) for t in b["text"]]
            if own:
                token, c = np.unique(np.concatenate(own), return_counts=True)
                yield pd.DataFrame({"token": token, "c": c})

    some = slim.where(F.pmod(F.xxhash64("id"), F.lit(SAMPLE_EVERY)) == 0)
    counts = some.mapInPandas(count, "token long, c long").groupBy("token").agg(F.sum("c").alias("c")).where("c >= 3")
    rows = counts.orderBy(F.desc("c"), "token").limit(FREQUENT).toArrow()
    return rows["token"].to_numpy()[::-1]


def _profiles(slim: DataFrame, n: int, percent: int, frequent) -> DataFrame:
    """Per row: id, the text's tag, set size, fingerprint, rarity and prefix tokens."""

    def profile(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words, order = kept("words", "hashes", WordHashes), frequent.value
        keys = np.sort(order)
        rank = np.argsort(order, kind="stable")
        for b in batches:
            rows = []
            for t in b["text"]:
                s = shingles(t, n, words)
                if not len(s):
                    rows.append((0, None, 0, [], None))
                    continue
                at = np.searchsorted(keys, s)
                at[at == len(keys)] = 0
                common = keys[at] == s if len(keys) else np.zeros(len(s), bool)
                rare = s[~common]
                size = len(s) - -(-len(s) * percent // 100) + 1
                prefix = rare[:size]
                if len(prefix) < size:
                    late = s[common]
                    late = late[np.argsort(rank[at[common]], kind="stable")]
                    prefix = np.concatenate([prefix, late[: size - len(prefix)]])
                rows.append((len(s), xxhash.xxh3_128_digest(s.tobytes()), 1000 * len(rare) // len(s), prefix, histogram(s).tobytes()))
            out = pd.DataFrame(rows, columns=["n", "print", "rarity", "prefix", "histogram"])
            out.insert(0, "id", b["id"].to_numpy())
            out.insert(1, "tag", b["tag"].to_numpy())
            yield out

    return slim.mapInPandas(profile, "id long, tag long, n int, print binary, rarity int, prefix array<long>, histogram binary")


class _Group:
    """Members of a group (or a chunk of it) as token lists."""

    def __init__(self, ids: list[int], sets: list[np.ndarray]):
        self.ids, self.sets = np.array(ids, np.int64), sets
        self.sizes = np.array([len(s) for s in sets], np.int64)
        flat = np.concatenate(sets)
        owner = np.repeat(np.arange(len(sets)), self.sizes)
        order = np.argsort(flat, kind="stable")
        self.owner = owner[order]
        self.tokens, self.begin, self.count = np.unique(flat[order], return_index=True, return_counts=True)
        self.label = np.arange(len(sets))

    def opened(self, s: np.ndarray, percent: int, own: bool) -> np.ndarray | None:
        """Places of the query's tokens, if the union's bound lets the query be similar to a member."""
        at = np.searchsorted(self.tokens, s)
        at[at == len(self.tokens)] = 0
        at = at[self.tokens[at] == s]
        if own:  # the query is a member: its tokens must be held by another too
            at = at[self.count[at] > 1]
        return at if 100 * len(at) >= percent * len(s) else None

    def links(self, s: np.ndarray, percent: int, own: bool) -> np.ndarray:
        at = self.opened(s, percent, own)
        if at is None:
            return at
        n = self.count[at]
        where = np.repeat(self.begin[at] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        inter = np.bincount(self.owner[where], minlength=len(self.sets))
        return np.flatnonzero(similar(inter, self.sizes + len(s), percent))


def _open_group(rows: list[tuple], percent: int) -> tuple[list, list]:
    """Links of one group (leader first), and the queries left if it is only a chunk."""
    leader, chunks = rows[0][0], rows[0][2]
    ids, sets = [r[1] for r in rows], [r[3] for r in rows]
    first = sets[0]
    flat = np.concatenate(sets)
    starts = np.cumsum([0, *(len(s) for s in sets[:-1])])
    at = np.searchsorted(first, flat)
    at[at == len(first)] = 0
    inter = np.add.reduceat((first[at] == flat).astype(np.int64), starts)
    sizes = np.array([len(s) for s in sets])
    linked = similar(inter, sizes + len(first), percent)
    linked[0] = True
    edges = [(leader, ids[i]) for i in np.flatnonzero(linked)[1:]]
    rest = np.flatnonzero(~linked)
    if chunks > 1:
        return edges, [(leader, ids[i]) for i in rest]
    if len(rest) and len(ids) > 2:
        group = _Group(ids, sets)
        group.label[linked] = 0
        for u in rest:
            hits = group.links(sets[u], percent, True)
            for x in hits if hits is not None else ():
                if group.label[x] != group.label[u]:
                    edges.append((ids[x], ids[u]))
                    group.label[group.label == group.label[u]] = group.label[x]
    return edges, []


def _runs(batches: Iterator[pd.DataFrame], key: list[str]) -> Iterator[list[tuple]]:
    """Rows of each key from a stream that is sorted by it."""
    held, at = [], None
    for b in batches:
        for row in b.itertuples(index=False, name=None):
            k = row[: len(key)]
            if k != at and held:
                yield held
                held = []
            at = k
            held.append(row)
    if held:
        yield held


def _width(df: DataFrame) -> int:
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)


def _spots(members: DataFrame, chunk_tokens: int, own: DataFrame | None = None) -> DataFrame:
    """Where each member goes: id, array of (leader, chunks, chunk); a leader goes to all chunks.

    With ``own`` (id, doc, tag) also the document and the tag of the text that is the member's.
    """
    load = members.groupBy("leader").agg(F.sum("n").alias("load"), F.count("*").alias("c"))
    parts = F.greatest(F.ceil(F.col("load") / chunk_tokens), F.ceil(F.col("c") / CHUNK_MEMBERS)).cast("int")
    # few leaders have more than a chunk, at most one for so many tokens or members
    split = materialize(load.select("leader", parts.alias("parts")).where("parts > 1"), "split")
    if split.count() <= BROADCAST_BYTES // 16:
        split = F.broadcast(split)
    placed = members.join(split, "leader", "left").select("leader", "id", F.coalesce("parts", F.lit(1)).alias("chunks"))
    chunks = F.col("chunks")
    chunk = F.when(F.col("leader") == F.col("id"), F.sequence(F.lit(0), chunks - 1)).otherwise(F.array(F.pmod(F.xxhash64("id"), chunks).cast("int")))
    spots = placed.groupBy("id").agg(F.collect_list(F.struct("leader", "chunks", chunk.alias("chunk"))).alias("spots"))
    spots = materialize(spots if own is None else spots.join(own, "id"), "spots")
    # a row, and each of its structs with an array of chunks
    held = spots.agg(F.coalesce(F.sum(40 + F.size("spots") * 64), F.lit(0))).head()[0]
    return F.broadcast(spots) if held <= BROADCAST_BYTES else spots


def _dealt(rows: DataFrame, *values: str) -> DataFrame:
    """Rows with ``spots``, once for each spot, a group's rows in one partition and its leader first."""
    each = rows.select("id", *values, F.explode("spots").alias("s")).select(
        F.col("s.leader").alias("leader"), "id", F.col("s.chunks").alias("chunks"), *values, F.explode("s.chunk").alias("chunk")
    )
    each = each.select("leader", "chunk", (F.col("leader") != F.col("id")).alias("later"), "id", "chunks", *values)
    return each.repartition(_width(rows), "leader", "chunk").sortWithinPartitions("leader", "chunk", "later", "id")


def _living(profiles: DataFrame, members: DataFrame, percent: int, chunk_tokens: int) -> DataFrame:
    """The members (leader, id, n) that the histograms leave; those of split groups all stay."""

    def keep(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out = []
        for run in _runs(batches, ["leader", "chunk"]):
            if run[0][4] > 1:
                stay = np.ones(len(run), bool)
            else:
                stay = alive([r[5] for r in run], [r[6] for r in run], percent)
            if stay.any():
                stay[0] = True
                out += [(run[i][0], run[i][3], run[i][5]) for i in np.flatnonzero(stay)]
            if len(out) > 50_000:
                yield pd.DataFrame(out, columns=["leader", "id", "n"])
                out = []
        if out:
            yield pd.DataFrame(out, columns=["leader", "id", "n"])

    rows = profiles.select("id", "n", "histogram").join(_spots(members, chunk_tokens), "id")
    return _dealt(rows, "n", "histogram").mapInPandas(keep, "leader long, id long, n int").distinct()


def _links(slim: DataFrame, members: DataFrame, own: DataFrame, n: int, percent: int, chunk_tokens: int) -> DataFrame:
    """Links (a, b) from the groups. ``members``: leader, id, n; the leader is a member. ``own``: id, doc, tag of each set's text."""
    texts = slim.select(F.col("id").alias("doc"), "tag", "text")
    sets = texts.join(_spots(members, chunk_tokens, own), ["doc", "tag"])

    @F.pandas_udf("array<long>")
    def as_set(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        words = kept("words", "hashes", WordHashes)
        for s in texts:
            yield pd.Series([shingles(t, n, words) for t in s])

    sets = sets.select("id", "spots", as_set("text").alias("tokens"))
    rows = _dealt(sets, "tokens")

    def groups(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out = []
        for run in _runs(batches, ["leader", "chunk"]):
            found = [(r[0], r[3], r[4], np.asarray(r[5], np.int64)) for r in run]
            found = [found[0], *(x for x in found[1:] if x[1] != x[0])]  # a leader's repeated rows
            if found[0][0] != found[0][1]:
                raise ValueError("a group has lost its leader")
            edges, rest = _open_group(found, percent)
            out += [(a, b, True) for a, b in edges] + [(a, b, False) for a, b in rest]
            if len(out) > 50_000:
                yield pd.DataFrame(out, columns=["a", "b", "link"])
                out = []
        if out:
            yield pd.DataFrame(out, columns=["a", "b", "link"])

    out = materialize(rows.mapInPandas(groups, "a long, b long, link boolean"), "links")
    open_queries = out.where("not link").select(F.col("a").alias("leader"), F.col("b").alias("id")).distinct()
    links = out.where("link").select("a", "b")
    if open_queries.isEmpty():
        return links
    return links.unionByName(_across(rows, open_queries, percent))


def _across(rows: DataFrame, queries: DataFrame, percent: int, block: int = 2_000) -> DataFrame:
    """Links of the queries of split groups, against every chunk, in blocks of queries.

    A cell is (leader, chunk, block); the chunk's members are repeated for each
    block of queries, and each query for each chunk.
    """
    blocks = queries.groupBy("leader").agg(F.greatest(F.ceil(F.count("*") / block), F.lit(1)).cast("int").alias("blocks"))
    mine = rows.join(blocks, "leader")
    members = mine.where((F.col("leader") != F.col("id")) | (F.col("chunk") == 0)).select(
        "leader", "chunk", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.lit(0).alias("query"), "id", "tokens"
    )
    asked = mine.join(queries, ["leader", "id"], "left_semi").select(
        "leader",
        F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"),
        F.pmod(F.xxhash64("id", F.lit(1)), F.col("blocks")).cast("int").alias("block"),
        F.lit(1).alias("query"),
        "id",
        "tokens",
    )

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for run in _runs(batches, ["leader", "chunk", "block"]):
            own = [r for r in run if r[3] == 0]
            if not own or len(own) == len(run):
                continue
            group = _Group([r[4] for r in own], [np.asarray(r[5], np.int64) for r in own])
            out = []
            for r in run:
                if r[3] == 1:
                    hits = group.links(np.asarray(r[5], np.int64), percent, False)
                    out += [(int(group.ids[x]), r[4]) for x in (hits if hits is not None else ()) if group.ids[x] != r[4]]
            yield pd.DataFrame(out, columns=["a", "b"])

    both = members.unionByName(asked).repartition(_width(rows), "leader", "chunk", "block")
    return materialize(both.sortWithinPartitions("leader", "chunk", "block", "query", "id").mapInPandas(search, "a long, b long"), "across")


def components(edges: DataFrame) -> DataFrame:
    """(id, component) of every id in ``edges`` (a, b); a component is named by its smallest id.

    Each round maps every vertex to the neighbour (or itself) with the least
    random number, and contracts; the number of edges falls by a constant
    factor a round whatever the shape of the graph.
    """
    edges = materialize(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    labels = edges.select(F.col("a").alias("id")).union(edges.select("b")).distinct().withColumn("label", F.col("id"))
    turn = 0
    while not edges.isEmpty():
        turn += 1
        ranked = lambda c: F.struct(F.xxhash64(c, F.lit(turn)).alias("h"), F.col(c).alias("v"))  # noqa: B023, E731
        both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        best = both.groupBy("a").agg(F.min(ranked("b")).alias("near")).select("a", F.least("near", ranked("a"))["v"].alias("to"))
        best = materialize(best, "best")
        ends = edges.join(best, "a").select(F.col("to").alias("x"), F.col("b").alias("a")).join(best, "a").select("x", F.col("to").alias("y"))
        edges = ends.where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
        edges = materialize(edges, "edges")
        step = best.select(F.col("a").alias("label"), "to")
        labels = materialize(labels.join(step, "label", "left").select("id", F.coalesce("to", "label").alias("label")), "labels")
    names = labels.groupBy("label").agg(F.min("id").alias("component"))
    return labels.join(names, "label").select("id", "component")


def jaccard_components(
    docs: DataFrame, shingle: int, percent: int, id_col: str = "doc_id", text_col: str = "text", chunk_tokens: int = CHUNK_TOKENS
) -> DataFrame:
    """One row per row of ``docs``: id, n_shingles, component_id. ``percent``: least similarity, in percent."""
    spark = docs.sparkSession
    small_batches(spark)
    slim = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).withColumn("tag", F.xxhash64("text"))
    frequent = spark.sparkContext.broadcast(_frequent(slim, shingle))
    base = materialize(_profiles(slim, shingle, percent, frequent), "profiles")
    sets = base.where("print is not null")
    reps = materialize(sets.groupBy("print").agg(F.min("id").alias("id")), "classes")
    ours = sets.join(reps.select("id", "print"), ["id", "print"], "left_semi").dropDuplicates(["id", "print"])
    # an id may lead several classes, so from here to the links a class goes by a number of its own
    ours = ours.select(F.monotonically_increasing_id().alias("id"), F.col("id").alias("doc"), "tag", "n", "rarity", "prefix", "histogram")
    ours = materialize(ours, "distinct")
    texts = ours.select("id", "doc", "tag")
    tokens = ours.select("id", "n", "rarity", F.explode("prefix").alias("token"))
    # a token that one document alone has in its prefix links nothing
    shared = tokens.groupBy("token").count().where("count > 1").select("token")
    tokens = materialize(tokens.join(shared, "token"), "shared")
    # similar sets lie in the same or in adjoining bands of size: each set is put into its own and the next
    band = F.floor(F.log(F.col("n")) / float(np.log(100 / percent)) + 1e-9).cast("int")
    tokens = tokens.withColumn("band", F.explode(F.array(band, band + 1)))
    # the leader: fewest rare tokens, then the longest
    rank = F.struct("rarity", (-F.col("n")).alias("m"), "id")
    heads = tokens.groupBy("token", "band").agg(F.min(rank).alias("head"), F.count("*").alias("c")).where("c > 1")
    heads = heads.select("token", "band", F.col("head.id").alias("leader"), (-F.col("head.m")).alias("leader_n"))
    pairs = materialize(tokens.join(heads, ["token", "band"]).select("leader", "leader_n", "id", "n").distinct(), "pairs")
    own = pairs.select("leader", "leader_n").distinct().select("leader", F.col("leader").alias("id"), F.col("leader_n").alias("n"))
    members = pairs.where("leader <> id").select("leader", "id", "n").unionByName(own)
    living = materialize(_living(ours, materialize(members, "members"), percent, chunk_tokens), "living")
    links = _links(slim, living, texts, shingle, percent, chunk_tokens)
    doc = texts.select(F.col("id").alias("a"), F.col("doc").alias("x"))
    links = links.join(doc, "a").select("x", "b").join(doc.withColumnsRenamed({"a": "b", "x": "y"}), "b").select(F.col("x").alias("a"), F.col("y").alias("b"))
    named = components(links)
    classes = reps.join(named, "id", "left").select("print", F.coalesce("component", "id").alias("component"))
    out = base.select("id", "n", "print").join(classes, "print", "left")
    return out.select(F.col("id").alias(id_col), F.col("n").cast("long").alias("n_shingles"), F.coalesce("component", "id").alias("component_id"))


def op9_group_jaccard(spark, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents").select("doc_id", "text"), shingle=4, percent=85)
