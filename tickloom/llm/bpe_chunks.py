"""BPE encoding and decoding with reuse of content-defined chunks.

A rolling hash over the last bytes cuts texts where content says so, so equal passages
give equal chunks wherever they stand. Cuts lie before white space that follows another character, of any script, and after
ideographic punctuation before a letter: no piece of the tokenizer's pattern crosses such a place, and what comes after it is
split without regard to what came before, so encodings on both sides can simply be joined (a "safe" cut).
A stretch of more than LONG bytes without a safe cut (scripts written without spaces) is cut between characters, by content too, and
where even that gives none within MOST bytes, anywhere between two characters.

1. The chunks' 128-bit hashes are counted over all documents; those in two places or more are
   marked in a bitmap of fixed size (a false positive only makes a chunk take the longer way).
2. Documents with a marked chunk are taken apart: runs of other chunks are encoded on the
   spot, marked chunks become references, and each marked text leaves a partition once. Each is
   then encoded once, and its tokens are joined back to the references and put together.
   Documents without a marked chunk are encoded where they are read.
3. Joins at unsafe cuts are repaired: the tokens around the join are decoded and encoded
again, in a window that doubles until the new tokens agree with the old ones at both its ends. Byte-pair encodings are
those sequences whose neighbouring tokens are encoded as they are, so agreement makes the whole exact.

`round_trip` tells whether the tokens decode to the text's bytes (by hash where the text is no longer at hand).
Defined cases: a null text has null tokens and is no round trip; an empty one has none and is; rows of
equal or null ids are encoded each on their own; ids are integers; other columns are ignored; an empty table gives no rows.
The bitmap is of fixed size: where more chunks recur than it can tell apart, more documents are taken apart, with the same tokens.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.llm.bitmaps import BITS
from tickloom.llm.shared import P_BYTE, T_BYTE, integer_id, map_arrow, materialise, mix, need, prefix_sums, row_slices, span_hash, text_bytes

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Bytes that the rolling hash looks back on; a safe place is cut once in 2^MASK_BITS; stretches beyond LONG without one are cut at one in 2^(MASK_BITS + 1) characters; the longest chunk.
LOOK_BACK, MASK_BITS, LONG, MOST = 48, 7, 4096, 16384

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 13, 32]] = True
_PRINT = np.zeros(256, dtype=bool)
_PRINT[33:127] = True


@lru_cache(maxsize=4)
def encoding(path: str = VOCABULARY):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
    return tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def decode(tokens, path: str = VOCABULARY) -> str:
    return encoding(path).decode_bytes(list(tokens)).decode("utf-8")


def token_type(enc) -> type:
    """How tokens are kept between the stages: in two bytes where the vocabulary allows it."""
    return np.uint16 if enc.n_vocab <= 1 << 16 else np.uint32


def safe_places(buf: np.ndarray) -> np.ndarray:
    """Where the text can be cut and its parts encoded apart: before white space after anything else; between ideographic punctuation and a letter."""
    n = len(buf)
    at = np.flatnonzero((buf[1:] <= 32) & (buf[:-1] > 32)) + 1
    at = at[_SPACE[buf[at]]]
    keep = _PRINT[buf[at - 1]]
    high = np.flatnonzero(buf[at - 1] >= 0x80)
    one, two, three = (np.where(at[high] >= k, buf[np.maximum(at[high] - k, 0)], 0) for k in (1, 2, 3))
    # White space beyond ASCII ends in these bytes.
    wide = (two == 0xC2) & ((one == 0x85) | (one == 0xA0)) | (three == 0xE1) & (two == 0x9A) & (one == 0x80) | (three == 0xE3) & (two == 0x80) & (one == 0x80)
    wide |= (three == 0xE2) & ((two == 0x80) & ((one <= 0x8A) | (one == 0xA8) | (one == 0xA9) | (one == 0xAF)) | (two == 0x81) & (one == 0x9F)) & (one >= 0x80)
    keep[high] = ~wide
    at = at[keep]
    i = np.flatnonzero((buf[3:-2] >= 0xE3) & (buf[3:-2] <= 0xED)) + 3
    if n < 6 or not len(i):
        return at
    a, b, c = buf[i - 3], buf[i - 2], buf[i - 1]
    i = i[(a == 0xE3) & (b == 0x80) & ((c == 0x81) | (c == 0x82) | (c == 0x8D)) | (a == 0xEF) & (b == 0xBC) & ((c == 0x81) | (c == 0x8C) | (c == 0x9F))]
    x, y, z = buf[i], buf[i + 1], buf[i + 2]
    letter = (x == 0xE4) & (y >= 0xB8) | (x >= 0xE5) & (x <= 0xE8) | (x == 0xE9) & (y <= 0xBE) | (x == 0xEA) & (y >= 0xB0) | (x == 0xEB) | (x == 0xEC) | (x == 0xED) & (y <= 0x9D)
    letter |= (x == 0xE3) & ((y == 0x81) & (z >= 0x82) | (y == 0x82) & ((z <= 0x96) | (z >= 0xA1)) | (y == 0x83) & (z <= 0xBA))
    return np.union1d(at, i[letter])


def cut_places(buf: np.ndarray, off: np.ndarray, mask_bits: int = MASK_BITS, most: int = MOST, long: int = LONG) -> tuple[np.ndarray, np.ndarray]:
    """All chunk starts in the bytes of the rows (each row's start among them, unless it is empty), and whether each is safe."""
    n = len(buf)
    begins = np.unique(off[:-1][np.diff(off) > 0])
    if n == 0:
        return begins, np.ones(0, bool)
    sums = prefix_sums(T_BYTE[buf], P_BYTE)

    def chosen(at: np.ndarray, bits: int) -> np.ndarray:
        """Of the places those that the bytes before them, in the same row, choose."""
        at = at[at >= LOOK_BACK]
        h = mix(span_hash(sums, at - LOOK_BACK, at, P_BYTE), 3)
        at = at[h & np.uint64((1 << bits) - 1) == 0]
        return at[at - begins[np.searchsorted(begins, at, "right") - 1] >= LOOK_BACK]

    def gaps(cuts: np.ndarray, least: int) -> list[tuple[int, int]]:
        ends = np.append(cuts[1:], n)
        return [(int(cuts[k]), int(ends[k])) for k in np.flatnonzero(ends - cuts > least)]

    places = safe_places(buf)
    safe = np.zeros(n, dtype=bool)
    safe[begins] = True
    places = places[~safe[places]]
    safe[places] = True
    cuts = np.union1d(begins, chosen(places, mask_bits))
    # Long stretches first take every safe place that fewer bits choose, and only what is still long is cut elsewhere.
    more = [chosen(places[slice(*np.searchsorted(places, (a + 1, z)))], max(0, mask_bits - 2)) for a, z in gaps(cuts, min(long, most))]
    cuts = np.union1d(cuts, np.concatenate(more)) if more else cuts
    more = [chosen(a + 1 + np.flatnonzero(buf[a + 1 : z] & 0xC0 != 0x80), mask_bits + 1) for a, z in gaps(cuts, min(long, most))]
    cuts = np.union1d(cuts, np.concatenate(more)) if more else cuts
    forced = []
    for a, z in gaps(cuts, most):
        while z - a > most:
            a += most
            while buf[a] & 0xC0 == 0x80:  # not inside a character
                a -= 1
            forced.append(a)
    cuts = np.union1d(cuts, np.array(forced, dtype=np.int64)) if forced else cuts
    return cuts, safe[cuts]


def chunked(col: pa.Array | pa.ChunkedArray, mask_bits: int = MASK_BITS, most: int = MOST) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Slices of rows [a, b) with their bytes and offsets, chunk starts, whether they are safe, and the chunks' two hashes."""
    buf, off = text_bytes(col)
    for a, b in row_slices(off):
        part, o = buf[off[a] : off[b]], off[a : b + 1] - off[a]
        cuts, safe = cut_places(part, o, mask_bits, most)
        ends = np.append(cuts[1:], len(part)) if len(cuts) else cuts
        raw = memoryview(part)
        h = np.frombuffer(b"".join([xxhash.xxh3_128_digest(raw[x:z]) for x, z in zip(cuts.tolist(), ends.tolist())]), np.uint64)
        yield a, b, part, o, cuts, safe, h[::2].copy(), h[1::2].copy()


def _count_batches(mask_bits: int, most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [(h1, h2) for *_, h1, h2 in chunked(b.column(0), mask_bits, most)]
            if got:
                h = np.stack([np.concatenate([g[k] for g in got]) for k in (0, 1)], axis=1)
                u, n = np.unique(h, axis=0, return_counts=True) if len(h) else (h, np.zeros(0, np.int64))
                yield pa.RecordBatch.from_arrays([pa.array(u[:, 0].copy().view(np.int64)), pa.array(u[:, 1].copy().view(np.int64)), pa.array(n.astype(np.int64))], ["h1", "h2", "n"])

    return run


def shared_chunks(docs: DataFrame, bits: int, mask_bits: int, most: int) -> np.ndarray:
    """The bitmap (2^bits bits) of the chunks that occur twice or more; of fixed size."""
    n = docs.select("text").transform(map_arrow, _count_batches(mask_bits, most), "h1 long, h2 long, n long").groupBy("h1", "h2").agg(F.sum("n").alias("n")).where("n > 1")
    at = n.select(F.pmod("h1", F.lit(1 << bits).cast("bigint")).alias("b"))
    maps = at.groupBy(F.bitmap_bucket_number("b").alias("k")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("b")).alias("m"))
    # Bit b is at position (b - 1) of bucket 1 + (b - 1) / 32768; 0 is at position 0 of bucket 0, which is left out: such a chunk is never marked.
    out = np.zeros((1 << bits) // 8 + 4096, dtype=np.uint8)
    for r in maps.collect():
        if r["k"] == 0:
            continue
        out[(r["k"] - 1) * 4096 : r["k"] * 4096] = np.frombuffer(r["m"], np.uint8)
    return out


def _marked(bitmap: np.ndarray, h1: np.ndarray, bits: int) -> np.ndarray:
    b = (h1 & np.uint64((1 << bits) - 1)).astype(np.int64) - 1
    return (bitmap[b >> 3] >> (b & 7) & 1).astype(bool) & (b >= 0)


def _str(part: np.ndarray, a: int, b: int) -> str:
    return part[a:b].tobytes().decode("utf-8")


def join_tokens(pieces: list[tuple[bool, np.ndarray]], enc) -> np.ndarray:
    """The pieces' tokens as one, repaired at the starts of pieces that aren't safe."""
    inside = lambda token: enc.decode_single_token_bytes(token)[0] & 0xC0 == 0x80
    done: list[int] = []
    for safe, tokens in pieces:
        right = tokens.tolist()
        if safe or not done:
            done += right
            continue
        m = 16
        while True:
            a, b = max(0, len(done) - m), min(len(right), m)
            while a > 0 and inside(done[a]):  # windows begin and end between characters
                a -= 1
            while b < len(right) and inside(right[b]):
                b += 1
            again = enc.encode_ordinary(enc.decode_bytes(done[a:] + right[:b]).decode("utf-8"))
            if (a == 0 or again[:2] == done[a : a + 2]) and (b == len(right) or again[-2:] == right[b - 2 : b]):
                break
            m *= 2
        done[a:] = again
        done += right[b:]
    return np.array(done, dtype=np.uint32)


def encode_whole(text: str, enc) -> np.ndarray:
    return np.array(enc.encode_ordinary(text), dtype=np.uint32)


PIECES = "rid long, seq int, safe boolean, h1 long, h2 long, tokens binary, chunk string, doc_id long, digest long"


def _piece_batches(bitmap, bits: int, mask_bits: int, most: int, path: str):
    """Documents with a marked chunk, taken apart. rid is unique in the stage: made from the partition's and the row's number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(path)
        sent: set[tuple[int, int]] = set()
        for batch in batches:
            ids, rids = batch.column(0).to_pylist(), batch.column(2).to_pylist()
            rows: list[tuple] = []
            for a, b, part, o, cuts, safe, h1, h2 in chunked(batch.column(1), mask_bits, most):
                hit = _marked(bitmap.value, h1, bits)
                ends = np.append(cuts[1:], len(part))
                lo = np.searchsorted(cuts, o[:-1])
                hi = np.searchsorted(cuts, o[1:])
                s1, s2 = h1.view(np.int64), h2.view(np.int64)
                some = np.concatenate([[0], np.cumsum(hit)])
                for i in np.flatnonzero(some[hi] > some[lo]):
                    digest = xxhash.xxh64_intdigest(part[o[i] : o[i + 1]].tobytes()) - (1 << 63)
                    k, seq = lo[i], 0
                    while k < hi[i]:
                        if hit[k]:
                            key = (int(s1[k]), int(s2[k]))
                            text = None
                            if key not in sent:
                                sent.add(key)
                                text = _str(part, cuts[k], ends[k])
                            rows.append((rids[a + i], seq, bool(safe[k]), *key, None, text, ids[a + i], digest))
                            k += 1
                        else:
                            z = k + 1
                            while z < hi[i] and not hit[z]:
                                z += 1
                            tokens = encode_whole(_str(part, cuts[k], ends[z - 1]), enc)
                            rows.append((rids[a + i], seq, bool(safe[k]), None, None, tokens.astype(token_type(enc)).tobytes(), None, ids[a + i], digest))
                            k = z
                        seq += 1
            if rows:
                names = [c.split()[0] for c in PIECES.split(", ")]
                kinds = [pa.int64(), pa.int32(), pa.bool_(), pa.int64(), pa.int64(), pa.binary(), pa.string(), pa.int64(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names)

    return run


OUT = "doc_id long, n_tokens int, tokens array<int>, round_trip boolean"


def _out(ids: list, tokens: list[np.ndarray | None], good: list[bool]) -> pa.RecordBatch:
    n = [None if t is None else len(t) for t in tokens]
    off = np.concatenate([[0], np.cumsum([0 if t is None else len(t) for t in tokens])]).astype(np.int32)
    flat = np.concatenate([t for t in tokens if t is not None] or [np.zeros(0, np.uint32)]).astype(np.int32)
    mask = pa.array([t is None for t in tokens], pa.bool_())
    lists = pa.ListArray.from_arrays(pa.array(off), pa.array(flat), mask=mask)
    return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(n, pa.int32()), lists, pa.array(good, pa.bool_())], ["doc_id", "n_tokens", "tokens", "round_trip"])


def _plain_batches(bitmap, bits: int, mask_bits: int, most: int, path: str):
    """Documents without a marked chunk, encoded whole."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(path)
        for whole in batches:
            for k in range(0, whole.num_rows, 1000):
                batch = whole.slice(k, 1000)
                ids, null = batch.column(0).to_pylist(), batch.column(1).is_null().to_numpy(zero_copy_only=False)
                out: list[tuple] = []
                for a, b, part, o, cuts, safe, h1, h2 in chunked(batch.column(1), mask_bits, most):
                    some = np.concatenate([[0], np.cumsum(_marked(bitmap.value, h1, bits))])
                    plain = some[np.searchsorted(cuts, o[1:])] == some[np.searchsorted(cuts, o[:-1])]
                    for i in np.flatnonzero(plain):
                        if null[a + i]:
                            out.append((ids[a + i], None, False))
                            continue
                        raw = part[o[i] : o[i + 1]].tobytes()
                        tokens = enc.encode_ordinary(raw.decode("utf-8"))
                        out.append((ids[a + i], np.array(tokens, dtype=np.uint32), enc.decode_bytes(tokens) == raw))
                if out:
                    yield _out(*map(list, zip(*out)))

    return run


def _encode_batches(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(path)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([encode_whole(t, enc).astype(token_type(enc)).tobytes() for t in b.column(2).to_pylist()], pa.binary())], ["h1", "h2", "known"])

    return run


def _join_batches(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(path)
        for b in batches:
            ids, tokens, good = [], [], []
            for doc_id, digest, pieces in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist()):
                t = join_tokens([(p["safe"], np.frombuffer(p["tokens"], token_type(enc)).astype(np.uint32)) for p in pieces], enc)
                ids.append(doc_id)
                tokens.append(t)
                good.append(xxhash.xxh64_intdigest(enc.decode_bytes(t.tolist())) - (1 << 63) == digest)
            if ids:
                yield _out(ids, tokens, good)

    return run


def encode_documents(docs: DataFrame, path: str = VOCABULARY, bits: int = BITS, mask_bits: int = MASK_BITS, most: int = MOST) -> DataFrame:
    """(doc_id, n_tokens, tokens, round_trip) of every row."""
    need(docs, "doc_id", "text")
    d = docs.select(integer_id(docs).alias("doc_id"), "text")
    bitmap = d.sparkSession.sparkContext.broadcast(shared_chunks(d, bits, mask_bits, most))
    plain = d.transform(map_arrow, _plain_batches(bitmap, bits, mask_bits, most, path), OUT)
    apart = d.withColumn("rid", F.monotonically_increasing_id()).transform(map_arrow, _piece_batches(bitmap, bits, mask_bits, most, path), PIECES)
    pieces = materialise(apart, "bpe-pieces")
    texts = pieces.where("chunk is not null").groupBy("h1", "h2").agg(F.min("chunk").alias("chunk"))
    known = texts.transform(map_arrow, _encode_batches(path), "h1 long, h2 long, known binary")
    refs = pieces.where("h1 is not null").select("rid", "seq", "safe", "h1", "h2", "doc_id", "digest").join(known, ["h1", "h2"]).select("rid", "seq", "safe", F.col("known").alias("tokens"), "doc_id", "digest")
    rest = pieces.where("h1 is null").select("rid", "seq", "safe", "tokens", "doc_id", "digest")
    whole = refs.unionAll(rest).groupBy("rid").agg(F.first("doc_id").alias("doc_id"), F.first("digest").alias("digest"), F.sort_array(F.collect_list(F.struct("seq", "safe", "tokens"))).alias("pieces"))
    joined = whole.select("doc_id", "digest", "pieces").transform(map_arrow, _join_batches(path), OUT)
    return plain.unionAll(joined)
