"""A prefix trie of rebuilt conversations, from fingerprints that compose.

Rebuilt, a conversation takes its head from its base conversation and goes on with its own turns after as many.  No rebuilt text is made.
A sequence of turns has as fingerprint an element of a monoid, (sum of turn value i times base to the i, base to the length), with product
(s, b)(t, c) = (s + b t, b c), in four prime fields.  Each stored turn knows the product of the turns up to it; the product of
a rebuilt prefix is that of the base's head times that of the own suffix, which the own head's inverse brings to its place.
Equal products of equal depth are one node.  That equal products are equal turns is then verified, turn by turn, on the stored turns
that the nodes refer to; should two be unlike, all is done again in other fields of values.

What a node's subtree holds needs no walk: a node belongs to the smallest conversation that passes through it, so sums over a subtree are
sums over the conversations that pass through its top, each of which knows where the nodes of its own begin.

Turns go by ``turn``, nulls first; ties by a hash of role and text, so their order does not depend on the order of rows, and equal rows
are turns of their own.  A null role or text is an empty one.  Rows with a null id belong to no conversation and take no part.  Turns of
one conversation may lie in many tasks: turns are sorted in ranges, each task multiplies what it has, and one row a task carries the
products on.  An empty table gives no nodes; without turns after the rebuilding there is the root alone.  Long texts are only
hashed, counted and compared in place.  Other columns are not looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .store import written

#: The four largest primes below 2 ** 31: a product of two residues fits in a long.
MODULI = (2147483647, 2147483629, 2147483587, 2147483579)
LANES = range(len(MODULI))
WORD = r"[^\x20\x09-\x0D]+"
#: Conversations of a family share the head of the first; a head has fewer turns than HEADS.
FAMILY, HEADS = 20, 4
#: Attempts with other values before a collision counts as an error.
ATTEMPTS = 8
#: Letters of ids in one row while the ends of a node are hashed.
_CHUNK = 1 << 14
KEY = ["depth", "key_a", "key_b"]


def _bases(seed: int, moduli: Sequence[int]) -> list[int]:
    return [int(x) for x in np.random.default_rng(100 + seed).integers(2, np.array(moduli))]


def _powers(base: int, modulus: int, exponents: np.ndarray) -> np.ndarray:
    """base ** exponents in the field, by squaring."""
    out, square = np.ones(len(exponents), np.int64), base % modulus
    for bit in range(int(exponents.max(initial=0)).bit_length()):
        out = np.where((exponents >> bit) & 1, out * square % modulus, out)
        square = square * square % modulus
    return out


def stored_turns(turns: DataFrame, seed: int, moduli: Sequence[int], conv_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    """(conv_id, pos, role, text, words, s0.., e0..): turns in their order, with the product of all turns up to each (s) and before it (e), and the words of all up to it."""
    spark = turns.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    bases = _bases(seed, moduli)
    own = turns.where(F.col(conv_col).isNotNull()).select(F.col(conv_col).cast("long").alias("conv_id"), F.col(turn_col).alias("turn"), F.coalesce(role_col, F.lit("")).alias("role"), F.coalesce(text_col, F.lit("")).alias("text"), F.monotonically_increasing_id().alias("row"))
    hashes = [F.xxhash64(F.lit(2 * seed + i), "role", "text") for i in (0, 1)]
    own = own.select("*", *[F.pmod(hashes[i // 2], F.lit(moduli[i])).cast("int").alias(f"a{i}") for i in LANES], F.regexp_count("text", F.lit(WORD)).cast("long").alias("n_words"))
    by = ["conv_id", "turn", "a0", "a3", "row"]
    ranged = own.repartitionByRange(n, *by).sortWithinPartitions(*by).select(F.spark_partition_id().alias("pid"), "conv_id", "role", "text", "n_words", *[f"a{i}" for i in LANES])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, count, words, sums = None, 0, 0, [0] * len(bases)
        for b in batches:
            if not len(b):
                continue
            conv, new_words = b.column(1).to_numpy(), b.column(4).to_numpy()
            first = np.concatenate([[True], conv[1:] != conv[:-1]])
            begins = np.flatnonzero(first)
            run = np.cumsum(first) - 1
            goes_on = conv[0] == last
            place = np.arange(len(conv)) - begins[run]
            place[run == 0] += count if goes_on else 0

            def running(x: np.ndarray, before: int) -> np.ndarray:
                total = np.cumsum(x)
                out = total - (total - x)[begins][run]
                out[run == 0] += before if goes_on else 0
                return out

            up_to = running(new_words, words)
            ended, before = [], []
            for i, (base, p) in enumerate(zip(bases, moduli, strict=True)):
                term = b.column(5 + i).to_numpy().astype(np.int64) * _powers(base, p, place) % p
                s = running(term, sums[i]) % p
                ended.append(s)
                before.append((s - term) % p)
                sums[i] = int(s[-1])
            last, count, words = conv[-1], int(place[-1]) + 1, int(up_to[-1])
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(place), b.column(2), b.column(3), pa.array(up_to), *[pa.array(x.astype(np.int32)) for x in (*ended, *before)]], ["pid", "conv_id", "pos", "role", "text", "words", *[f"{k}{i}" for k in "se" for i in LANES]])

    sums = ", ".join(f"{k}{i} int" for k in "se" for i in LANES)
    local = written(ranged.mapInArrow(scan, f"pid int, conv_id long, pos long, role string, text string, words long, {sums}"), "turns")

    # one row a task: the product of its last conversation's turns there
    last = F.struct("conv_id", "pos", "words", *[f"s{i}" for i in LANES])
    borders = local.groupBy("pid").agg(F.min("conv_id").alias("first"), F.max_by(last, F.struct("conv_id", "pos")).alias("last")).orderBy("pid").collect()
    carried, conv, count, words, product = [], None, 0, 0, [0] * len(bases)
    for r in borders:
        if r.first == conv:
            carried.append((r.pid, conv, count, words, product, [pow(b, count, p) for b, p in zip(bases, moduli, strict=True)]))
        here = [r.last[f"s{i}"] for i in LANES]
        if r.first == conv == r.last.conv_id:
            product = [(s + pow(b, count, p) * t) % p for s, t, b, p in zip(product, here, bases, moduli, strict=True)]
            count, words = count + r.last.pos + 1, words + r.last.words
        else:
            conv, count, words, product = r.last.conv_id, r.last.pos + 1, r.last.words, here
    if not carried:
        return local.drop("pid")
    # at most one row for each shuffle partition
    before = spark.createDataFrame(carried, "pid int, conv_id long, n long, w long, s array<long>, b array<long>")
    both = local.alias("t").join(F.broadcast(before.alias("c")), ["pid", "conv_id"], "left")

    def moved(k: str, i: int) -> Column:
        return F.when(F.col("c.n").isNull(), F.col(f"t.{k}{i}")).otherwise(((F.col("c.s")[i] + F.col("c.b")[i] * F.col(f"t.{k}{i}")) % moduli[i]).cast("int")).alias(f"{k}{i}")

    return both.select("conv_id", (F.col("pos") + F.coalesce("c.n", F.lit(0))).alias("pos"), "role", "text", (F.col("words") + F.coalesce("c.w", F.lit(0))).alias("words"), *[moved(k, i) for k in "se" for i in LANES])


def rebuilt(turns: DataFrame, seed: int, moduli: Sequence[int]) -> DataFrame:
    """(conv_id, h, head, n_head, length, words, b0.., o0.., u0..): for each conversation how it is rebuilt.

    ``head`` has (words before, product before, words, product) of each of the ``n_head`` turns that the base gives, b is the product of these,
    o that of the own first h turns, and u what moves the own suffix from place h to place n_head.
    """
    lanes = [f"s{i}" for i in LANES]
    firsts = [F.max(F.when(F.col("pos") == j, F.col(x))).alias(f"{x}_{j + 1}") for j in range(HEADS - 1) for x in ["words", *lanes]]
    flat = turns.groupBy("conv_id").agg((F.max("pos") + 1).alias("n"), F.max("words").alias("words"), *firsts)
    zero = F.struct(F.lit(0).cast("long").alias("words"), *[F.lit(0).alias(x) for x in lanes])
    prefix = F.array(zero, *[F.struct(*[F.col(f"{x}_{j}").alias(x) for x in ["words", *lanes]]) for j in range(1, HEADS)])
    heads = written(flat.select("conv_id", "n", "words", prefix.alias("prefix")), "heads")
    base = heads.select(F.col("conv_id").alias("base"), F.col("n").alias("base_n"), F.col("prefix").alias("base_prefix"))
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % HEADS).cast("int")
    own = heads.select("*", h.alias("h"), (F.col("conv_id") - F.col("conv_id") % FAMILY).alias("base")).join(base, "base", "left")
    own = own.withColumn("n_head", F.least(F.col("h"), F.coalesce("base_n", F.lit(0))).cast("int")).withColumn("h", F.least("h", "n").cast("int")).withColumn("given", F.when(F.col("n_head") > 0, F.slice("base_prefix", 1, F.col("n_head") + 1)).otherwise(F.array(zero)))
    end, start = F.element_at("given", -1), F.get("prefix", F.col("h"))
    moves = [[pow(b, -k, p) for k in range(HEADS)] for b, p in zip(_bases(seed, moduli), moduli, strict=True)]
    more = F.greatest(F.lit(0), F.col("n") - F.col("h"))
    return own.select(
        "conv_id", "h", "n_head", F.col("given").alias("head"), (F.col("n_head") + more).alias("length"),
        (end["words"] + F.col("words") - start["words"]).alias("words"), (end["words"] - start["words"]).alias("words_moved"),
        *[end[f"s{i}"].alias(f"b{i}") for i in LANES], *[start[f"s{i}"].alias(f"o{i}") for i in LANES],
        *[F.get(F.array(*map(F.lit, moves[i])), F.col("h") - F.col("n_head")).cast("long").alias(f"u{i}") for i in LANES],
    )


def _packed(lanes: Sequence[Column], names: Sequence[str]) -> list[Column]:
    """Two longs of two residues each."""
    one = F.lit(1 << 31)
    return [(lanes[2 * i].cast("long") * one + lanes[2 * i + 1].cast("long")).alias(names[i]) for i in (0, 1)]


def own_turns(turns: DataFrame, convs: DataFrame, moduli: Sequence[int], *extra: str) -> DataFrame:
    """(conv_id, depth, key_a, key_b, parent_a, parent_b, words_before, ends) of each stored turn that goes on from a head, or is the head of its own conversation."""

    def there(k: str, i: int) -> Column:
        suffix = F.pmod(F.col(f"{k}{i}").cast("long") - F.col(f"o{i}"), F.lit(moduli[i]))
        return (F.col(f"b{i}") + suffix * F.col(f"u{i}")) % moduli[i]

    convs = convs.select("conv_id", "h", "n_head", "length", "words_moved", *[f"{k}{i}" for k in "bou" for i in LANES])
    rows = turns.join(convs, "conv_id").where(F.expr("pos >= h") | (F.col("conv_id") % FAMILY == 0))
    depth = (F.col("n_head") + F.col("pos") - F.col("h") + 1).alias("depth")
    return rows.select("conv_id", depth, *_packed([there("s", i) for i in LANES], KEY[1:]), *_packed([there("e", i) for i in LANES], ["parent_a", "parent_b"]), (F.col("words_moved") + F.col("words_before")).alias("words_before"), (depth == F.col("length")).alias("ends"), *extra)


def members(turns: DataFrame, convs: DataFrame, moduli: Sequence[int]) -> DataFrame:
    """A row for each prefix of each rebuilt conversation: the root's, those of heads that are another's, those of own turns."""
    root = convs.select("conv_id", F.lit(0).cast("long").alias("depth"), *[F.lit(0).cast("long").alias(x) for x in ("key_a", "key_b", "parent_a", "parent_b", "words_before")], (F.col("length") == 0).alias("ends"))
    each = convs.where(F.col("conv_id") % FAMILY != 0).select("conv_id", "length", "head", F.explode(F.when(F.col("n_head") > 0, F.sequence(F.lit(1), F.col("n_head")))).alias("d"))
    here, before = F.get("head", F.col("d")), F.get("head", F.col("d") - 1)
    head = each.select("conv_id", F.col("d").cast("long").alias("depth"), *_packed([here[f"s{i}"] for i in LANES], KEY[1:]), *_packed([before[f"s{i}"] for i in LANES], ["parent_a", "parent_b"]), before["words"].alias("words_before"), (F.col("d") == F.col("length")).alias("ends"))
    slim = turns.select("conv_id", "pos", "words_before", *[f"{k}{i}" for k in "se" for i in LANES])
    return root.unionByName(head).unionByName(own_turns(slim, convs, moduli))


def ends_hashes(ends: DataFrame) -> DataFrame:
    """(depth, key_a, key_b, ends_sha256): of the ids in ascending order, joined by commas, for each key.

    A key's ids may be many: ranges of (key, id) are packed into strings, and these are hashed in their order as a stream.
    """
    n = int(ends.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    by = [*KEY, "conv_id"]
    ranged = ends.select(*by).repartitionByRange(n, *by).sortWithinPartitions(*by)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not len(b):
                continue
            columns = [c.to_numpy() for c in b.columns]
            new = np.zeros(len(b), bool)
            for c in columns[:3]:
                new[1:] |= c[1:] != c[:-1]
            new[0] = True
            ids = columns[3].astype(str)
            letters = np.cumsum(np.char.str_len(ids) + 1)
            new[1:] |= letters[1:] // _CHUNK != letters[:-1] // _CHUNK
            first = np.flatnonzero(new)
            text = [",".join(ids[i:j]) for i, j in zip(first, [*first[1:], len(b)], strict=True)]
            yield pa.RecordBatch.from_arrays([*[pa.array(c[first]) for c in columns], pa.array(text, pa.string())], [*by, "ids"])

    kinds = "depth long, key_a long, key_b long"
    packed = ranged.mapInArrow(pack, f"{kinds}, conv_id long, ids string")

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, h = None, hashlib.sha256()
        for b in batches:
            done = []
            for *k, text in zip(*[b.column(i).to_pylist() for i in (0, 1, 2, 4)], strict=True):
                if k == key:
                    h.update(b",")
                else:
                    if key is not None:
                        done.append((*key, h.hexdigest()))
                    key, h = k, hashlib.sha256()
                h.update(text.encode())
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*done, strict=True)], [*KEY, "ends_sha256"])
        if key is not None:
            yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (*key, h.hexdigest())], [*KEY, "ends_sha256"])

    return packed.repartition(n, *KEY).sortWithinPartitions(*by).mapInArrow(stream, f"{kinds}, ends_sha256 string")


def verified(turns: DataFrame, convs: DataFrame, nodes: DataFrame, moduli: Sequence[int]) -> bool:
    """Whether the stored turns that a node refers to are equal, and so are its members' parents.

    Another's head consists of references to the base's stored turns, which are compared as the base's own.
    """
    if nodes.where("parent_a <> parent_a2 OR parent_b <> parent_b2").limit(1).count():
        return False
    texts = own_turns(turns, convs, moduli, "role", "text")
    same = texts.groupBy(*KEY).agg(*[f(x).alias(f"{name}_{x}") for x in ("role", "text") for name, f in (("min", F.min), ("max", F.max))])
    return not same.where("min_role <> max_role OR min_text <> max_text").limit(1).count()


def trie(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", moduli: Sequence[int] = MODULI) -> DataFrame:
    """(conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256) of each node; ``moduli`` are those of the first attempt."""
    for seed in range(ATTEMPTS):
        stored = stored_turns(turns, seed, moduli, conv_col, turn_col, role_col, text_col)
        # words before a turn, by the words up to it
        stored = stored.withColumn("words_before", F.col("words") - F.regexp_count("text", F.lit(WORD)))
        convs = written(rebuilt(stored, seed, moduli), "rebuilt")
        rows = written(members(stored, convs, moduli), "members")
        found = rows.groupBy(*KEY).agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.sum(F.col("ends").cast("long")).alias("n_ends"), F.min("words_before").alias("words_before"), F.min("parent_a").alias("parent_a"), F.max("parent_a").alias("parent_a2"), F.min("parent_b").alias("parent_b"), F.max("parent_b").alias("parent_b2"))
        nodes = written(found, "nodes")
        if verified(stored, convs, nodes, moduli):
            return _subtrees(convs, rows, nodes)
        moduli = MODULI
    raise ArithmeticError("fingerprints of unlike turns are equal in every attempt")


def _subtrees(convs: DataFrame, rows: DataFrame, nodes: DataFrame) -> DataFrame:
    # a conversation's own nodes begin where it is the smallest; a childless node is counted with its smallest
    smallest = nodes.groupBy("conv_id").agg(F.min_by("words_before", "depth").alias("shared"), F.max((F.col("n_ends") == F.col("n_convs")).cast("long")).alias("leaf"))
    at = convs.select("conv_id", "words").join(smallest, "conv_id", "left").select("conv_id", F.coalesce("shared", "words").alias("shared"), F.coalesce("leaf", F.lit(0)).alias("leaf"))
    sums = rows.join(at, "conv_id").groupBy(*KEY).agg(F.sum("leaf").alias("n_leaves"), F.sum(F.greatest(F.lit(0), F.col("shared") - F.col("words_before"))).alias("saved_tokens"))
    below = nodes.where("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("parent_a").alias("key_a"), F.col("parent_b").alias("key_b")).agg(F.count("*").alias("n_children"))
    root = nodes.where("depth = 0").select("conv_id").first()
    up = nodes.select((F.col("depth") + 1).alias("depth"), F.col("key_a").alias("parent_a"), F.col("key_b").alias("parent_b"), F.col("conv_id").alias("parent_conv_id")).where("depth > 1")
    # the root's children need no join; another node's many children are a skewed join that Spark splits
    deep = nodes.where("depth > 1").join(up, ["depth", "parent_a", "parent_b"]).select(*KEY, "conv_id", "n_convs", "parent_conv_id")
    top = nodes.where("depth <= 1").select(*KEY, "conv_id", "n_convs", F.when(F.col("depth") == 1, F.lit(root.conv_id if root else None)).cast("long").alias("parent_conv_id"))
    out = deep.unionByName(top).join(sums, KEY).join(below, KEY, "left").join(ends_hashes(rows.where("ends")), KEY, "left")
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", F.coalesce("n_children", F.lit(0)).alias("n_children"), "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"))
