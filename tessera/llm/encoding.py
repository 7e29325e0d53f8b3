"""Encoding of a corpus by a public byte-level BPE vocabulary, merged by recursive queries.

Every partition runs its own in-process DuckDB. The distinct words of a batch become token-position rows; a recursive
query joins neighbouring tokens with the merge table and contracts, word by word, the pair of least rank until no
word has a pair left; an ordered aggregation gives the ids, and another one decodes. A pair of least rank is contracted
at all of its places at once, from the left and without overlap, which is what contracting the leftmost one again and
again comes to: a token's own merges rank after the merge that makes it. The recursion is keyed by word and position, so
it holds the present token of every place only, whatever the number of rounds. Words are kept for the batches that follow.
"""

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: The pattern that splits a text into words before merging (GPT-2's, as published with the vocabulary).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Words kept per worker, and bytes of words merged by one query (a longer word has one of its own).
KEPT_WORDS, QUERY_BYTES = 300_000, 200_000


def vocabulary_path(name: str = "byte_bpe_50k.json") -> str:
    """File of a public vocabulary; the folder may be given by the environment of the installation."""
    import public_tokenizers

    return public_tokenizers.path(name)


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte in the vocabulary: itself where printable, else 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters, n = {b: chr(b) for b in plain}, 0
    for b in range(256):
        if b not in letters:
            letters[b], n = chr(256 + n), n + 1
    return [letters[b] for b in range(256)]


_MERGE = """
WITH RECURSIVE t(w, pos, tok) USING KEY (w, pos) AS (
  SELECT w, pos, tok FROM words
  UNION
  SELECT w, pos, CASE WHEN take THEN merged WHEN gone THEN -1 ELSE tok END
  FROM (
    SELECT *, coalesce(lag(take) OVER (PARTITION BY w ORDER BY pos), false) AS gone
    FROM (
      SELECT *, coalesce(hit AND (row_number() OVER (PARTITION BY w, hit, island ORDER BY pos)) % 2 = 1, false) AS take
      FROM (
        SELECT *, n - row_number() OVER (PARTITION BY w, hit ORDER BY pos) AS island
        FROM (
          SELECT *, coalesce(rank = min(rank) OVER (PARTITION BY w), false) AS hit, min(rank) OVER (PARTITION BY w) AS best
          FROM (
            SELECT p.*, m.rank, m.merged
            FROM (SELECT w, pos, tok, lead(tok) OVER (PARTITION BY w ORDER BY pos) AS nxt,
                         row_number() OVER (PARTITION BY w ORDER BY pos) AS n
                  FROM recurring.t WHERE tok >= 0 AND w IN (SELECT w FROM t)) p
            LEFT JOIN merges m ON m.a = p.tok AND m.b = p.nxt))
        WHERE best IS NOT NULL))))
SELECT w, list(tok ORDER BY pos) AS ids FROM t WHERE tok >= 0 GROUP BY w
"""
_DECODE = """
SELECT d, string_agg(piece, '' ORDER BY pos) AS hex FROM tokens JOIN pieces USING (tok) GROUP BY d
"""


class Encoder:
    """Encodes texts with one vocabulary file; holds the merge table and the words met so far."""

    def __init__(self, vocabulary: str):
        import duckdb
        import regex

        with open(vocabulary, encoding="utf-8") as f:
            model = json.load(f)["model"]
        vocab = model["vocab"]
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        table = [(vocab[a], vocab[b], vocab[a + b]) for a, b in pairs]
        self.byte_ids = np.array([vocab[c] for c in byte_letters()], np.int32)
        self.words: dict[str, np.ndarray] = {}
        self.split = regex.compile(PATTERN).findall
        self.db = duckdb.connect(":memory:", config={"threads": 1, "memory_limit": "400MB", "temp_directory": ""})
        a, b, m = (pa.array(c, pa.int32()) for c in zip(*table))
        self.db.register("merge_rows", pa.table({"a": a, "b": b, "merged": m, "rank": pa.array(range(len(table)), pa.int32())}))
        self.db.execute("CREATE TABLE merges AS SELECT * FROM merge_rows")

    def learn(self, words: list[str]) -> None:
        """Merges words that are not known yet, those of like length together."""
        raw = sorted(((w, w.encode("utf-8", "surrogatepass")) for w in words), key=lambda r: len(r[1]))
        group = np.cumsum([len(r) for _, r in raw]) // QUERY_BYTES
        for part in np.split(np.arange(len(raw)), np.flatnonzero(np.diff(group)) + 1):
            if len(part):
                self._merge([raw[i] for i in part])

    def _merge(self, part: list[tuple[str, bytes]]) -> None:
        size = np.array([len(raw) for _, raw in part])
        start = np.cumsum(size) - size
        rows = pa.table({
            "w": pa.array(np.repeat(np.arange(len(part), dtype=np.int32), size)),
            "pos": pa.array((np.arange(size.sum()) - np.repeat(start, size)).astype(np.int32)),
            "tok": pa.array(self.byte_ids[np.frombuffer(b"".join(raw for _, raw in part), np.uint8)]),
        })
        self.db.register("words", rows)
        got = self.db.sql(_MERGE).to_arrow_table().combine_chunks()
        ids = got["ids"].combine_chunks() if isinstance(got["ids"], pa.ChunkedArray) else got["ids"]
        flat, off = ids.values.to_numpy(), ids.offsets.to_numpy()
        for k, w in enumerate(got["w"].to_pylist()):
            self.words[part[w][0]] = flat[off[k] : off[k + 1]].copy()
        self.db.unregister("words")

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after the other, and the number of each; NULL and empty texts have none."""
        parts = [self.split(t) if t else [] for t in texts]
        fresh = {w for p in parts for w in p if w not in self.words}
        if len(self.words) + len(fresh) > KEPT_WORDS:
            self.words, fresh = {}, {w for p in parts for w in p}
        self.learn(list(fresh))
        known = self.words
        arrays = [known[w] for p in parts for w in p]
        per_word = np.fromiter((len(a) for a in arrays), np.int64, len(arrays))
        ends = np.cumsum([len(p) for p in parts]) if parts else np.empty(0, np.int64)
        total = np.concatenate([[0], np.cumsum(per_word)])
        upto = total[ends.astype(np.int64)]
        return (np.concatenate(arrays) if arrays else np.empty(0, np.int32)), np.diff(np.concatenate([[0], upto]))


def _slices(batches: Iterator[pa.RecordBatch], most_bytes: int = 8_000_000) -> Iterator[pa.RecordBatch]:
    """Batches of about ``most_bytes`` of text; a longer text is a batch of its own."""
    for batch in batches:
        size = np.array([len(t.encode("utf-8", "surrogatepass")) if t else 0 for t in batch.column("text").to_pylist()])
        group = np.cumsum(size) // most_bytes
        cuts = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts[:-1], cuts[1:]):
            if b > a:
                yield batch.slice(a, b - a)


def encode_documents(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """doc_id and ids (array of int) of every document, without special tokens.

    NULL and empty texts have an empty list. Repeated rows are encoded each; a NULL doc_id is kept; an empty table
    gives no rows; other columns are ignored. Texts are encoded whole, whatever their length.
    """
    path = vocabulary or vocabulary_path()

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = None
        for batch in _slices(batches):
            encoder = encoder or Encoder(path)
            ids, n = encoder.encode(batch.column("text").to_pylist())
            lists = pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum(n)]).astype(np.int32), pa.array(ids, pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), lists], ["doc_id", "ids"])

    return docs.select("doc_id", "text").mapInArrow(rows, "doc_id bigint, ids array<int>")


def count_tokens(docs: DataFrame, *keep: str, vocabulary: str | None = None) -> DataFrame:
    """The columns ``keep`` of every document with ``n_tokens`` (0 for NULL and empty texts)."""
    path = vocabulary or vocabulary_path()
    source = docs.select(*keep, "text")
    schema = ", ".join(f"`{c}` {t}" for c, t in source.dtypes if c != "text") + ", n_tokens bigint"

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = None
        for batch in _slices(batches):
            encoder = encoder or Encoder(path)
            n = encoder.encode(batch.column("text").to_pylist())[1]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(n, pa.int64())], [*keep, "n_tokens"])

    return source.mapInArrow(rows, schema)


def decode_documents(encoded: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """doc_id and text of encoded documents; an empty list gives the empty text, a NULL list NULL."""
    path = vocabulary or vocabulary_path()

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        db = None
        for batch in batches:
            if db is None:
                import duckdb

                db = duckdb.connect(":memory:", config={"threads": 1, "memory_limit": "400MB", "temp_directory": ""})
                byte = {c: b for b, c in enumerate(byte_letters())}
                with open(path, encoding="utf-8") as f:
                    vocab = [(i, bytes(byte[c] for c in t).hex()) for t, i in json.load(f)["model"]["vocab"].items() if all(c in byte for c in t)]
                db.register("piece_rows", pa.table({"tok": pa.array([i for i, _ in vocab], pa.int32()), "piece": pa.array([p for _, p in vocab])}))
                db.execute("CREATE TABLE pieces AS SELECT * FROM piece_rows")
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                lists = part.column("ids")
                tokens = lists.flatten()
                n = np.nan_to_num(lists.value_lengths().to_numpy(zero_copy_only=False)).astype(np.int64)
                db.register("tokens", pa.table({"d": pa.array(np.repeat(np.arange(len(n)), n)), "pos": pa.array(np.arange(len(tokens))), "tok": tokens}))
                got = dict(db.sql(_DECODE).fetchall())
                db.unregister("tokens")
                texts = [None if null else bytes.fromhex(got.get(i, "")).decode("utf-8", "replace") for i, null in enumerate(lists.is_null().to_pylist())]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(rows, "doc_id bigint, text string")
