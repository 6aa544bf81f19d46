"""BPE encoding and decoding with content-defined chunk reuse (operator 7).

A text is cut where a rolling hash of the last bytes hits a mask, so equal passages of different documents
yield equal chunks. encode_once encodes a chunk that several documents hold once for all of them; encode, which does
not shuffle, once in each worker, as long as the chunk stays in use. A cut may fall inside
a token, so every join is repaired: the stretch from the last safe place before the cut to the first one after
it is encoded again as one string and replaces the tokens that the two chunks gave for it. A safe place is where
the vocabulary's pattern always starts a token, whatever stands around it, so both sides agree exactly from there
on: a space between two characters of any script that are no white space, or the punctuation of a Chinese or
Japanese sentence after a letter. Where two cuts share such a stretch, the later cut is given up, down to encoding
the whole text at once.

Edge cases: a null or empty text has no ids and decodes to the empty text; a text without a safe place is encoded
whole; repeated rows give repeated rows; other columns pass through.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cinegraph.llm.common import drop_scratch, flagged, from_text, gram_hash, passes, prefix_hash, scratch, slices, tune

ROLL = 16
CHUNK_MASK = 1023
CACHE_BYTES = 12 << 20
#: Fixed value: the splitting pattern of the public byte-level vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

_VISIBLE = np.zeros(256, bool)
_VISIBLE[0x21:0x7F] = True
#: The first two bytes of characters among which white space is found, and sentence punctuation of Chinese and Japanese.
_SPACE_PAIRS = [0xE19A, 0xE280, 0xE281, 0xE380]
_CJK_STOPS = [0xE38081, 0xE38082, 0xEFBC81, 0xEFBC8C, 0xEFBC9B, 0xEFBC9F]
_LOADED: dict[str, Codec] = {}


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _byte_of() -> dict[str, int]:
    """Byte-level vocabularies write a byte as a printable character: itself, or the next free one from U+0100."""
    keep = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in keep]
    return {chr(b): b for b in keep} | {chr(256 + i): b for i, b in enumerate(rest)}


class Codec:
    """One vocabulary, loaded once in each worker, with the worker's chunk cache."""

    def __init__(self, path: str):
        import tiktoken

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        byte_of = _byte_of()
        ranks = {bytes(byte_of[c] for c in token): i for token, i in spec["model"]["vocab"].items() if all(c in byte_of for c in token)}
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        ranks = {k: v for k, v in ranks.items() if v not in set(special.values())}
        self.special = set(special)
        assert not any(c.isspace() for s in special for c in s), "a special token with white space could span a safe place"
        self.core = tiktoken.Encoding("chunked", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=special)
        pieces = {i: b for b, i in ranks.items()} | {i: s.encode() for s, i in special.items()}
        size = np.zeros(max(pieces) + 1, np.int64)
        for i, b in pieces.items():
            size[i] = len(b)
        self.size, self.start = size, np.concatenate([[0], np.cumsum(size)[:-1]])
        self.blob = np.frombuffer(b"".join(pieces.get(i, b"") for i in range(len(size))), np.uint8)
        self.cache: dict[bytes, np.ndarray] = {}
        self.older: dict[bytes, np.ndarray] = {}
        self.held = 0

    def plain(self, text: bytes) -> np.ndarray:
        return self.core.encode_to_numpy(text.decode("utf-8", "replace"), allowed_special=self.special, disallowed_special=())

    def chunk(self, text: bytes) -> np.ndarray:
        ids = self.cache.get(text)
        if ids is None:
            if self.held > CACHE_BYTES // 2:  # what is not asked for while the newer half fills up goes
                self.cache, self.older, self.held = {}, self.cache, 0
            ids = self.older.get(text)
            ids = self.cache[text] = self.plain(text) if ids is None else ids
            self.held += len(text) + ids.nbytes + 200
        return ids

    def encode(self, text: bytes, cuts: list[tuple[int, int, int]], given: dict[int, np.ndarray] | None = None) -> np.ndarray:
        """cuts: (safe place before, cut, safe place after), in order, without overlaps; given: ids of chunks by their place."""
        of = lambda i, a, b: given[i] if given and i in given else self.chunk(text[a:b])
        if not cuts:
            return of(0, 0, len(text))
        out, begin, skip = [], 0, 0
        for i, (left, cut, right) in enumerate(cuts):
            ids = of(i, begin, cut)
            tail, head, joined = text[left:cut], text[cut:right], text[left:right]
            out += [ids[skip : len(ids) - len(self.plain(tail))], self.plain(joined)]
            begin, skip = cut, len(self.plain(head)) if head else 0
        out.append(of(len(cuts), begin, len(text))[skip:])
        return np.concatenate(out)

    def decode(self, ids: np.ndarray) -> bytes:
        n = self.size[ids]
        end = np.cumsum(n)
        return self.blob[np.repeat(self.start[ids] - (end - n), n) + np.arange(end[-1] if len(end) else 0)].tobytes()


def codec(path: str) -> Codec:
    if path not in _LOADED:
        _LOADED[path] = Codec(path)
    return _LOADED[path]


def safe_places(data: np.ndarray) -> np.ndarray:
    """Where a token starts whatever stands around; some such places are left out, none is wrong."""
    n = len(data)
    if n < 5:
        return np.zeros(0, np.int64)
    wide = np.concatenate([np.zeros(3, np.uint8), data, np.zeros(3, np.uint8)]).astype(np.int64)  # data[i] is wide[i + 3]
    at = np.flatnonzero(data[1:-1] == 0x20) + 1
    before = _VISIBLE[data[at - 1]]
    last, mid, lead = wide[at + 2], wide[at + 1], wide[at]
    three = (last & 0xC0 == 0x80) & (mid & 0xC0 == 0x80) & ~np.isin(lead << 8 | mid, _SPACE_PAIRS)
    two = (last & 0xC0 == 0x80) & (mid >= 0xC3) & (mid < 0xE0)
    first, second = wide[at + 4], wide[at + 5]
    after = _VISIBLE[data[at + 1]] | ((first >= 0xC3) & ~np.isin(first << 8 | second, _SPACE_PAIRS))
    spaces = at[(before | three | two) & after]
    stop = np.flatnonzero((data == 0xE3) | (data == 0xEF))
    stop = stop[(stop > 2) & np.isin(wide[stop + 3] << 16 | wide[stop + 4] << 8 | wide[stop + 5], _CJK_STOPS)]
    lead, mid, last = wide[stop], wide[stop + 1], wide[stop + 2]
    kana = (lead == 0xE3) & (((mid == 0x81) & (last >= 0x81)) | ((mid == 0x82) & (last <= 0x96)))
    letter = (mid & 0xC0 == 0x80) & (last & 0xC0 == 0x80) & (((lead >= 0xE5) & (lead <= 0xE9)) | kana)
    return np.union1d(spaces, stop[letter])


def find_cuts(data: np.ndarray, off: np.ndarray, roll: int = ROLL, mask: int = CHUNK_MASK) -> list[list[tuple[int, int, int]]]:
    """For each row of the pass, its cuts with the safe places around them, relative to the row."""
    out: list[list[tuple[int, int, int]]] = [[] for _ in range(len(off) - 1)]
    if len(data) <= roll + 2:
        return out
    hits = np.flatnonzero((gram_hash(prefix_hash(data), roll) & np.uint64(mask)) == 0) + roll
    hits = hits[(hits < len(data))]
    hits = hits[(data[hits] & 0xC0) != 0x80]
    safe = safe_places(data)
    if not len(safe) or not len(hits):
        return out
    row = np.searchsorted(off, hits, "right") - 1
    k = np.searchsorted(safe, hits)  # safe[k] is the first place at or after the cut
    ok = (k > 0) & (k < len(safe))
    hits, row, k = hits[ok], row[ok], k[ok]
    left, right = safe[k - 1], safe[k]
    ok = (hits - roll >= off[row]) & (left > off[row]) & (right + 1 < off[row + 1])
    last_row, last_right = -1, 0
    for r, a, c, b in zip(row[ok].tolist(), left[ok].tolist(), hits[ok].tolist(), right[ok].tolist(), strict=True):
        if r != last_row or a >= last_right:
            base = int(off[r])
            out[r].append((a - base, c - base, b - base))
            last_row, last_right = r, b
    return out


def encode(df: DataFrame, text: str = "text", ids: str = "ids", vocabulary: str | None = None, decoded: str | None = None, agrees: str | None = None) -> DataFrame:
    """Adds a binary column: the ids of the text as little-endian unsigned 32-bit integers.

    With `decoded` a column of that name holds the ids decoded again, with `agrees` another one whether they give the
    text back; both come from the same worker.
    """
    tune(df.sparkSession)
    path = vocabulary or default_vocabulary()
    more = [x for x in (decoded, agrees) if x]
    kept = df.drop(ids, *more)

    def run(data: np.ndarray, off: np.ndarray) -> pa.Array:
        c, raw = codec(path), data.tobytes()
        found, back, same = [], [], []
        for i, cuts in enumerate(find_cuts(data, off)):
            own = raw[off[i] : off[i + 1]]
            x = c.encode(own, cuts).astype("<u4")
            found.append(x.tobytes())
            if more:
                y = c.decode(x)
                same.append(y == own)
                back.append(y.decode("utf-8", "replace") if decoded else None)
        out = [pa.array(found, pa.binary()), pa.array(back, pa.string()) if decoded else None, pa.array(same, pa.bool_()) if agrees else None]
        return pa.StructArray.from_arrays([x for x in out if x is not None], names)

    names = ["i", *(["d"] if decoded else []), *(["s"] if agrees else [])]
    kinds = {"i": "binary", "d": "string", "s": "boolean"}
    own = from_text(run, "struct<" + ",".join(f"{n}:{kinds[n]}" for n in names) + ">")(F.col(text))
    at = "_" + max(kept.columns, key=len)  # no column of the input has this name
    return kept.withColumn(at, own).select(*kept.columns, *(F.col(f"{at}.{n}").alias(x) for n, x in zip(names, (ids, *more), strict=True)))


def _chunk_hashes(data: np.ndarray, off: np.ndarray) -> tuple[list[int], list[int], list[int], list[int]]:
    """Row, place, and a hash of 128 bits in two numbers of every chunk of a pass."""
    import xxhash

    raw = memoryview(data)
    row, place, h1, h2 = [], [], [], []
    for i, cuts in enumerate(find_cuts(data, off)):
        base, size = int(off[i]), int(off[i + 1] - off[i])
        edges = [0, *(c for _, c, _ in cuts), size]
        for j, (a, b) in enumerate(zip(edges, edges[1:], strict=False)):
            h = xxhash.xxh3_128_intdigest(raw[base + a : base + b])
            row.append(i)
            place.append(j)
            h1.append((h & (1 << 64) - 1) - (1 << 63))
            h2.append((h >> 64) - (1 << 63))
    return row, place, h1, h2


def encode_once(df: DataFrame, text: str = "text", ids: str = "ids", vocabulary: str | None = None, decoded: str | None = None) -> DataFrame:
    """As encode, but a chunk that several texts hold is encoded once for all of them, by the task that has its first text.

    Only hashes of chunks are counted. The shared chunks' ids are a table, which is joined to the texts that hold them;
    texts without a shared chunk are not shuffled. Texts are told apart by their content, so equal rows share a key.
    """
    tune(df.sparkSession)
    path = vocabulary or default_vocabulary()
    more = [decoded] if decoded else []
    names = [c for c in df.columns if c not in (ids, *more)]
    own = F.coalesce(F.col(text), F.lit(""))
    rows = df.select(F.struct(*names).alias("r"), F.xxhash64(own).alias("k"), F.hash(own).alias("m"))
    texts = rows.select("k", "m", F.coalesce(F.col(f"r.{text}"), F.lit("")).alias("text"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, data, off in passes(batches, "text"):
            row, place, h1, h2 = _chunk_hashes(data, off)
            back = pa.array(row, pa.int32())
            yield pa.RecordBatch.from_arrays([b.column(0).take(back), b.column(1).take(back), pa.array(place, pa.int32()), pa.array(h1, pa.int64()), pa.array(h2, pa.int64())], names=["k", "m", "i", "h1", "h2"])

    chunks = scratch(texts.where("text <> ''").mapInArrow(cut, "k long, m int, i int, h1 long, h2 long"), "bpe-chunks")
    shared = chunks.groupBy("h1", "h2").agg(F.count("*").alias("n"), F.min(F.struct("k", "m", "i")).alias("first")).where("n > 1")
    shared = scratch(shared.select("h1", "h2", "first"), "bpe-shared")
    uses = scratch(chunks.join(shared.select("h1", "h2"), ["h1", "h2"]).distinct(), "bpe-uses")
    drop_scratch(chunks)
    wanted = shared.select("first.k", "first.m", F.struct("first.i", "h1", "h2").alias("w")).groupBy("k", "m").agg(F.collect_list("w").alias("w"))
    source = flagged(texts, shared.select("first.k"), "k").where("flag").drop("flag").join(wanted, ["k", "m"]).dropDuplicates(["k", "m"])

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for b, data, off in passes(batches, "text"):
            raw = data.tobytes()
            h1, h2, found = [], [], []
            for i, (cuts, want) in enumerate(zip(find_cuts(data, off), b.column(b.schema.get_field_index("w")).to_pylist(), strict=True)):
                edges = [0, *(x for _, x, _ in cuts), int(off[i + 1] - off[i])]
                for w in want:
                    h1.append(w["h1"])
                    h2.append(w["h2"])
                    found.append(c.plain(raw[off[i] + edges[w["i"]] : off[i] + edges[w["i"] + 1]]).astype("<u4").tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(h1, pa.int64()), pa.array(h2, pa.int64()), pa.array(found, pa.binary())], names=["h1", "h2", "ids"])

    table = scratch(source.select("text", "w").mapInArrow(fill, "h1 long, h2 long, ids binary"), "bpe-table")
    given = uses.join(table, ["h1", "h2"]).groupBy("k", "m").agg(F.collect_list(F.struct("i", "ids")).alias("given"))
    given = scratch(given, "bpe-given")
    kinds = "struct<i:binary,d:string>" if decoded else "struct<i:binary>"

    @F.arrow_udf(kinds)
    def assemble(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        c = codec(path)
        for col, known in batches:
            out, back = [], []
            for at, data, off in slices(col):
                raw = data.tobytes()
                have = known.slice(at, len(off) - 1).to_pylist()
                for i, cuts in enumerate(find_cuts(data, off)):
                    x = c.encode(raw[off[i] : off[i + 1]], cuts, {g["i"]: np.frombuffer(g["ids"], "<u4") for g in have[i] or []}).astype("<u4")
                    out.append(x.tobytes())
                    back.append(c.decode(x).decode("utf-8", "replace") if decoded else None)
            yield pa.StructArray.from_arrays([pa.array(out, pa.binary()), *([pa.array(back, pa.string())] if decoded else [])], ["i", *(["d"] if decoded else [])])

    marked = flagged(rows, given, "k")
    some = marked.where("flag").join(given, ["k", "m"], "left").select("r", "given")
    plain = marked.where("not flag").select("r", F.lit(None).cast("array<struct<i:int,ids:binary>>").alias("given"))
    run = assemble.asNondeterministic()
    both = [x.select("r", run(F.col(f"r.{text}"), F.col("given")).alias("e")) for x in (some, plain)]
    return both[0].unionByName(both[1]).select("r.*", F.col("e.i").alias(ids), *([F.col("e.d").alias(decoded)] if decoded else []))


def decode(df: DataFrame, ids: str = "ids", text: str = "decoded", vocabulary: str | None = None) -> DataFrame:
    """Adds the text of the ids; bytes that are no UTF-8 become U+FFFD."""
    path = vocabulary or default_vocabulary()
    kept = df.drop(text)
    schema = T.StructType([*kept.schema.fields, T.StructField(text, T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for b, data, off in passes(batches, ids):
            raw = data.tobytes()
            found = [c.decode(np.frombuffer(raw[off[i] : off[i + 1]], "<u4")).decode("utf-8", "replace") for i in range(b.num_rows)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(found, pa.string())], names=[*b.schema.names, text])

    return kept.mapInArrow(run, schema)


def digests(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of a round trip over whole texts."""
    return encode_once(docs.select("doc_id", "text"), vocabulary=vocabulary, decoded="decoded").select(
        "doc_id",
        F.expr("octet_length(ids) div 4").cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
