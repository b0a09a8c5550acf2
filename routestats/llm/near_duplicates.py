"""Near-duplicate documents: MinHash, banding, verified links and connected components."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from routestats.llm.arrow import emit, map_rows
from routestats.llm.components import connected_components
from routestats.llm.words import mix, seeds, shingles, signed, word_hashes
from routestats.session import materialize

#: Words of a shingle; links need 100 * |A and B| >= SIMILARITY * |A or B|.
SHINGLE_WORDS, SIMILARITY = 5, 75
#: A pair of similarity 0.75 shares none of 32 bands of 4 minima with probability (1 - 0.75**4)**32 < 6e-6.
BANDS, BAND_ROWS = 32, 4
#: Minima in a signature, one byte of each; at 0.75, 192 of 256 agree (standard deviation 6.9).
MINIMA = 256
#: Minima in the longer signature of the last round, where all pairs of different components are weighed.
FINE_MINIMA = 1024
#: Rows of a bucket compared in one group; larger buckets are cut into blocks, and all pairs of blocks are compared.
BLOCK_ROWS = 1024
#: Partners tried per document in the second round, before all that are left.
BEST = 4

_A = seeds(11, FINE_MINIMA)[:, None] | np.uint64(1)
_B = seeds(12, FINE_MINIMA)[:, None]
_BAND_POWERS = seeds(13, BAND_ROWS) | np.uint64(1)
_BAND_SEEDS = seeds(14, BANDS)
_STEP = 256


def agreeing(minima: int) -> int:
    """Equal bytes from which a pair is compared in full: 4.5 standard deviations below what the threshold gives."""
    share = SIMILARITY / 100
    return int(minima * share - 4.5 * np.sqrt(minima * share * (1 - share)))


def signature(items: np.ndarray, minima: int = MINIMA) -> np.ndarray:
    """The minima of universal hashes a*x+b modulo 2**64, upper 32 bits, over the items.

    A longer signature begins with the shorter one.
    """
    least = np.full(minima, np.iinfo(np.uint64).max, np.uint64)
    room = np.empty((minima, min(_STEP, len(items))), np.uint64)
    for at in range(0, len(items), _STEP):
        part = items[at : at + _STEP]
        values = np.multiply(_A[:minima], part[None, :], out=room[:, : len(part)])
        values += _B[:minima]
        np.minimum(least, values.min(axis=1), out=least)
    return least >> np.uint64(32)


def band_keys(minima: np.ndarray) -> np.ndarray:
    rows = minima[: BANDS * BAND_ROWS].reshape(BANDS, BAND_ROWS)
    return mix((mix(rows) * _BAND_POWERS).sum(axis=1, dtype=np.uint64) + _BAND_SEEDS)


def text_shingles(text: str | None) -> np.ndarray:
    """The sorted distinct shingles of a text as 64-bit hashes, A-Z folded."""
    return shingles(word_hashes(text, lower=True), SHINGLE_WORDS)


_SKETCH = pa.schema([
    ("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("h1", pa.int64()), ("h2", pa.int64()),
    ("bands", pa.list_(pa.int64())), ("sig", pa.binary()),
])
_SKETCH_DDL = "doc_id long, n_shingles long, h1 long, h2 long, bands array<long>, sig binary"


def _sketch(rows: Iterable[tuple]) -> Iterator[tuple]:
    for doc_id, text in rows:
        items = text_shingles(text)
        if not len(items):
            yield doc_id, 0, None, None, None, None
            continue
        minima = signature(items)
        digest = [int(mix(items + seed).sum(dtype=np.uint64).view(np.int64)) for seed in seeds(15, 2)]
        yield doc_id, len(items), *digest, signed(band_keys(minima)).tolist(), minima.astype(np.uint8).tobytes()


def _fine(rows: Iterable[tuple]) -> Iterator[tuple]:
    unpack = zstandard.ZstdDecompressor()
    for doc_id, packed in rows:
        items = text_shingles(unpack.decompress(packed).decode("utf-8", "surrogatepass"))
        minima = signature(items, FINE_MINIMA)
        yield doc_id, len(items), signed(band_keys(minima)).tolist(), minima.astype(np.uint8).tobytes()


def _packed(rows: Iterable[tuple]) -> Iterator[tuple]:
    """Texts compressed before they are shuffled."""
    pack = zstandard.ZstdCompressor(level=1)
    for doc_id, text in rows:
        yield doc_id, pack.compress((text or "").encode("utf-8", "surrogatepass"))


def _agreement(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Keep the pairs whose signatures agree often enough."""
    for batch in batches:
        if batch.num_rows:
            one, two = (np.stack([np.frombuffer(x, np.uint8) for x in batch.column(i).to_pylist()]) for i in (2, 3))
            keep = (one == two).sum(axis=1) >= agreeing(MINIMA)
            yield batch.select([0, 1]).filter(pa.array(keep))


def _compared(rows: Iterable[tuple]) -> Iterator[tuple]:
    """Exact comparison of the full shingle sets of each pair; the set of the last ``a`` is reused."""
    unpack, last, have = zstandard.ZstdDecompressor(), None, None
    for a, b, text_a, text_b in rows:
        one, two = (None, None) if a != last else (have, None)
        if one is None:
            one = text_shingles(unpack.decompress(text_a).decode("utf-8", "surrogatepass"))
            last, have = a, one
        two = text_shingles(unpack.decompress(text_b).decode("utf-8", "surrogatepass"))
        both = len(one) + len(two) - len(np.union1d(one, two))
        yield a, b, 100 * both >= SIMILARITY * (len(one) + len(two) - both)


def _across(best: int | None):
    """Pairs of different components within one group of rows (bucket, block, block) whose signatures agree.

    ``best`` keeps only each outer row's partners that agree most. The rows of the largest component are only
    compared with the others, so a bucket that is nearly one component costs little. A pair that meets in several
    bands is given in the first of them.
    """

    def pairs(key: int, group: list[np.ndarray], bands: np.ndarray, sig: np.ndarray) -> Iterator[tuple]:
        left, right, own, rep, comp, size = group
        values, inverse, counts = np.unique(comp, return_inverse=True, return_counts=True)
        outer = inverse != counts.argmax()
        within = left[0] == right[0]
        for r in np.flatnonzero(outer):
            other = comp != comp[r]
            other &= ~outer | (np.arange(len(rep)) > r)  # pairs of two outer rows once
            if not within:
                other &= own != own[r]
            other &= (100 * np.minimum(size, size[r]) >= SIMILARITY * np.maximum(size, size[r])) & (rep != rep[r])
            near = np.flatnonzero(other)
            if len(near):
                shared = bands[near] == bands[r]
                near = near[bands[r, shared.argmax(axis=1)] == key]
            if len(near):
                same = (sig[near, :MINIMA] == sig[r, :MINIMA]).sum(axis=1)
                good = same >= agreeing(MINIMA)
                near, same = near[good], same[good]
                if sig.shape[1] > MINIMA:
                    near = near[(sig[near] == sig[r]).sum(axis=1) >= agreeing(sig.shape[1])]
                if best is not None and len(near) > best:
                    near = near[np.lexsort((rep[near], -same))[:best]]
                for s in near:
                    yield int(min(rep[r], rep[s])), int(max(rep[r], rep[s]))

    def groups(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple]:
        rest = None
        for batch in batches:
            table = pa.Table.from_batches([batch]) if rest is None else pa.concat_tables([rest, pa.Table.from_batches([batch])])
            rest = yield from cut(table, False)
        if rest is not None:
            yield from cut(rest, True)

    def cut(table: pa.Table, final: bool) -> Iterator[tuple]:
        if not table.num_rows:
            return table
        key, *columns = (table.column(i).to_numpy() for i in range(7))
        change = np.flatnonzero((np.diff(key) != 0) | (np.diff(columns[0]) != 0) | (np.diff(columns[1]) != 0)) + 1
        ends = [*change.tolist(), *([len(key)] if final else [])]
        bands, sig, start = table.column(7).combine_chunks(), table.column(8).combine_chunks(), 0
        for end in ends:
            if end - start > 1:
                rows = [c[start:end] for c in columns]
                bits = np.stack([np.frombuffer(x, np.uint8) for x in sig[start:end].to_pylist()])
                yield from pairs(key[start], rows, bands[start:end].flatten().to_numpy().reshape(-1, BANDS), bits)
            start = end
        return table.slice(start).combine_chunks()

    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])
    return lambda batches: emit(schema, groups(batches))


def _sketched_pairs(pairs: DataFrame, reps: DataFrame) -> DataFrame:
    """The pairs (a, b) whose sizes and signatures allow the similarity."""
    one = reps.select(F.col("rep").alias("a"), F.col("n_shingles").alias("n_a"), F.col("sig").alias("sig_a"))
    two = reps.select(F.col("rep").alias("b"), F.col("n_shingles").alias("n_b"), F.col("sig").alias("sig_b"))
    sized = pairs.join(two, "b").join(one, "a")
    sized = sized.where(100 * F.least("n_a", "n_b") >= SIMILARITY * F.greatest("n_a", "n_b"))
    return sized.select("a", "b", "sig_a", "sig_b").mapInArrow(_agreement, "a long, b long")


def _confirmed(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """(a, b, linked): each pair compared on its full sets."""
    one = texts.select(F.col("doc_id").alias("a"), F.col("packed").alias("text_a"))
    two = texts.select(F.col("doc_id").alias("b"), F.col("packed").alias("text_b"))
    both = pairs.join(two, "b").join(one, "a").select("a", "b", "text_a", "text_b")
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("linked", pa.bool_())])
    return materialize(map_rows(both, _compared, schema, "a long, b long, linked boolean"), "compared")


def _mixed(members: DataFrame, roots: DataFrame) -> DataFrame:
    """(key, rep, comp, blocks): the rows of the buckets that hold several components."""
    labelled = members.join(roots.withColumnRenamed("node", "rep"), "rep", "left")
    labelled = labelled.select("key", "rep", F.coalesce("root", "rep").alias("comp"))
    mixed = labelled.groupBy("key").agg(F.min("comp").alias("low"), F.max("comp").alias("high"), F.count("*").alias("n"))
    mixed = materialize(mixed.where("low < high").select("key", F.ceil(F.col("n") / BLOCK_ROWS).alias("blocks")), "keys")
    return materialize(labelled.join(mixed, "key"), "mixed")


def _crossing(mixed: DataFrame, reps: DataFrame, best: int | None) -> DataFrame:
    """Candidate pairs of different components in one bucket, compared block by block."""
    cut = mixed.withColumn("own", F.pmod(F.xxhash64("rep"), "blocks"))
    dealt = cut.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    dealt = dealt.select(
        "key", F.least("own", "other").alias("left"), F.greatest("own", "other").alias("right"), "own", "rep", "comp"
    )
    dealt = dealt.join(reps, "rep").select("key", "left", "right", "own", "rep", "comp", "n_shingles", "bands", "sig")
    ordered = dealt.repartition("key", "left", "right").sortWithinPartitions("key", "left", "right", "rep")
    return ordered.mapInArrow(_across(best), "a long, b long").distinct()


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for each row of ``docs`` (doc_id long, text string, others ignored).

    Two documents are linked if the Jaccard similarity of their five-word shingle sets is at least 0.75; a component
    is named by its smallest doc_id, and that document is kept. Shingles are 64-bit hashes.

    1. Documents with equal sets are one class; only its smallest doc_id goes on.
    2. Classes meet in bands of their MinHash signature. In every bucket each class is paired with the one that has
       met most others, which joins most large groups in one round; no bucket's pairs are listed.
    3. Pairs whose signatures agree often enough are compared on their full sets.
    4. Where a bucket still holds several components, rows of different components are compared by signature in
       bounded blocks: first each one's best partners, then, after joining, all that are left, by longer signatures.
    5. Components by large-star and small-star.

    Null, empty and blank texts have no shingles: they are kept and linked with nothing. A null doc_id is never
    linked, has a null component and is kept. Rows that repeat a doc_id are one document: they share its links.
    An empty table gives an empty result.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    sketches = materialize(map_rows(docs, _sketch, _SKETCH, _SKETCH_DDL, lambda _: 700), "sketches")
    named = sketches.where("n_shingles > 0 and doc_id is not null")
    # Sides that aggregate by the join's key are written first: a join of plain shuffles can be split at a hot key.
    classes = materialize(named.groupBy("h1", "h2").agg(F.min("doc_id").alias("rep")), "classes")
    member = materialize(named.select("doc_id", "h1", "h2").join(classes, ["h1", "h2"]), "members")
    heads = member.where("doc_id = rep").select("doc_id", "h1", "h2").distinct()
    chosen = named.join(heads, ["doc_id", "h1", "h2"]).dropDuplicates(["doc_id", "h1", "h2"])
    reps = materialize(chosen.select(F.col("doc_id").alias("rep"), "n_shingles", "bands", "sig"), "class-sketches")
    banded = reps.select(F.explode("bands").alias("key"), "rep")
    shared = materialize(banded.groupBy("key").agg(F.count("*").alias("met")).where("met > 1"), "shared")
    met = materialize(banded.join(shared, "key"), "buckets")
    members = met.select("key", "rep").distinct()
    packed = map_rows(docs, _packed, pa.schema([("doc_id", pa.int64()), ("packed", pa.binary())]), "doc_id long, packed binary",
                      lambda row: len(row[1]))
    texts = materialize(packed.join(met.select(F.col("rep").alias("doc_id")).distinct(), "doc_id"), "texts")

    degree = met.groupBy("rep").agg(F.sum("met").alias("degree"))
    hub = met.join(degree, "rep").groupBy("key").agg(F.max(F.struct("degree", -F.col("rep"))).alias("hub"))
    hub = materialize(hub.select("key", (-F.col("hub")[F.lit("col2")]).alias("hub")), "hubs")
    spokes = met.join(hub, "key").where("rep <> hub")
    spokes = spokes.select(F.least("rep", "hub").alias("a"), F.greatest("rep", "hub").alias("b")).distinct()
    tried = _confirmed(_sketched_pairs(spokes, reps), texts)
    roots = connected_components(tried.where("linked").select(F.col("a").alias("u"), F.col("b").alias("v")))
    for best in (BEST, None):
        mixed = _mixed(members, roots)
        if best is None:
            wanted = texts.join(mixed.select(F.col("rep").alias("doc_id")).distinct(), "doc_id", "left_semi")
            schema = pa.schema([("rep", pa.int64()), ("n_shingles", pa.int64()), ("bands", pa.list_(pa.int64())), ("sig", pa.binary())])
            reps = map_rows(wanted, _fine, schema, "rep long, n_shingles long, bands array<long>, sig binary", lambda _: 1400)
        pairs = _crossing(mixed, reps, best).join(tried, ["a", "b"], "left_anti")
        new = _confirmed(pairs, texts)
        links = new.where("linked").select(F.col("a").alias("u"), F.col("b").alias("v"))
        roots = connected_components(roots.select(F.col("node").alias("u"), F.col("root").alias("v")).unionByName(links))
        tried = tried.unionByName(new)

    placed = member.join(roots.withColumnRenamed("node", "rep"), "rep", "left")
    placed = placed.groupBy(F.col("doc_id").alias("of")).agg(F.min(F.coalesce("root", "rep")).alias("component"))
    rows = sketches.select("doc_id", "n_shingles").join(placed, F.col("doc_id") == F.col("of"), "left")
    component = F.coalesce("component", "doc_id")
    return rows.select(
        "doc_id", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept")
    )


def drop_near_duplicates(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are kept, with all their columns: one of each group of near duplicates, that of the
    smallest doc_id.

    Rows without an id or with an id of several rows are rows like others: of those alike one stays, one with an id if
    there is any. Texts without words all stay.
    """
    rows, ids = docs.agg(F.count("*"), F.count_distinct(docs["doc_id"].cast("long"))).first()
    if rows == ids:
        gone = near_duplicates(docs).where(~F.col("kept")).select(F.col("doc_id").alias("_gone_id"))
        return docs.join(gone, docs["doc_id"].cast("long") == F.col("_gone_id"), "left_anti")
    # The whole row is one column, so that its names can't clash with those used here.
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    numbered = materialize(docs.select(whole, F.monotonically_increasing_id().alias("at")), "numbered")
    own = numbered.select(F.col("at").alias("doc_id"), F.col("row.text").alias("text"))
    named = numbered.select(F.col("at").alias("doc_id"), F.col("row.doc_id").cast("long").alias("id"))
    first = F.min(F.struct(F.col("id").isNull(), "id", F.col("doc_id").alias("at"))).alias("first")
    kept = near_duplicates(own).join(named, "doc_id").groupBy("component_id").agg(first).select("first.at")
    return numbered.join(kept, "at", "left_semi").select("row.*")
