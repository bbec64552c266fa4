"""Packing of tokenised documents into fixed windows by multiway differencing."""

from __future__ import annotations

import heapq
import os
from collections.abc import Iterator
from functools import lru_cache
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orrery.llm.frames import documents, freed, named, slices

WINDOW = 4096
END_ID = 2
#: Documents that are packed together on average; enough windows that one more or less is little padding.
DOCS_PER_BLOCK = 1024
#: Words a worker remembers; then it starts anew.
REMEMBERED = 300_000
#: Text that is encoded at a time: words that repeat in it are looked up once.
ENCODED_BYTES = 4 << 20

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


class WordIds:
    """Ids of texts by the `tokenizers` library, which is asked once for each distinct word.

    The tokenizer never joins across white space, so a text's ids are those of its chunks between ASCII white space in turn.
    A chunk of letters and trailing punctuation is two pre-tokens of the library's pattern, letters being lowered first; their
    ids are learnt from long lines of distinct words, whose ids are told apart by the vocabulary's word ends. Other
    chunks are encoded one by one as they are.
    """

    #: A-Z and the letters of Latin-1, which lower to one letter each; ASCII punctuation without apostrophe or white space.
    _SIMPLE = "^(?P<letters>[A-Za-zÀ-ÖØ-öø-ÿ]*)(?P<marks>[.,;:!?#*$%&|<>()/=\"_-]*)$"

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self._of = Tokenizer.from_file(path)
        vocab = self._of.get_vocab()
        self._ends = np.zeros(max(vocab.values()) + 1, bool)
        self._ends[[i for word, i in vocab.items() if word.endswith("</w>") or word.startswith("<|")]] = True
        self._known: dict[str, bytes] = {"": b""}

    def _encode(self, text: str) -> np.ndarray:
        return np.array(self._of.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")

    def _learn(self, words: list[str]) -> None:
        for i in range(0, len(words), 1000):
            some = words[i : i + 1000]
            ids = self._encode(" ".join(some))
            cuts = (np.flatnonzero(self._ends[ids]) + 1).tolist()
            if len(cuts) != len(some) or cuts[-1] != len(ids):
                for w in some:
                    self._known[w] = self._encode(w).tobytes()
                continue
            raw, at = ids.tobytes(), 0
            for w, cut in zip(some, cuts, strict=True):
                self._known[w] = raw[4 * at : 4 * cut]
                at = cut

    def chunks(self, chunks: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For distinct chunks: the two words of each as numbers of words, and the words' ids in turn with how many each has."""
        if len(self._known) > REMEMBERED:
            self._known = {"": b""}
        split = pc.extract_regex(chunks, self._SIMPLE)
        odd = pc.or_(pc.is_null(split), pc.match_substring(chunks, "<|"))
        words = pc.if_else(odd, "", pc.utf8_lower(pc.fill_null(pc.struct_field(split, 0), ""))), pc.if_else(odd, "", pc.fill_null(pc.struct_field(split, 1), ""))
        coded = pa.concat_arrays(words).dictionary_encode()
        own = coded.dictionary.to_pylist()
        self._learn(sorted(w for w in own if w not in self._known))
        ids = [self._known[w] for w in own]
        both = coded.indices.to_numpy().reshape(2, -1).copy()
        for k in np.flatnonzero(odd.to_numpy(zero_copy_only=False)).tolist():
            both[0, k] = len(ids)
            ids.append(self._encode(chunks[k].as_py()).tobytes())
        if not len(both[0]):
            ids = [b""]
        return both, np.frombuffer(b"".join(ids), "<u4"), np.fromiter(map(len, ids), np.int32, len(ids)) // 4

    def texts(self, texts: pa.Array) -> Iterator[np.ndarray]:
        """The ids of each text of an Arrow array without nulls."""
        words = pc.ascii_split_whitespace(texts)
        bounds = words.offsets.to_numpy()
        coded = words.values.slice(bounds[0], bounds[-1] - bounds[0]).dictionary_encode()
        both, flat, sizes = self.chunks(coded.dictionary)
        first = np.cumsum(sizes, dtype=np.int32) - sizes
        at = both[:, coded.indices.to_numpy()].T.ravel()
        each = sizes[at]
        ends = np.cumsum(each)
        ids = flat[np.repeat(first[at] - (ends - each).astype(np.int32), each) + np.arange(ends[-1] if len(ends) else 0, dtype=np.int32)]
        ends = np.concatenate([[0], ends])[2 * (bounds - bounds[0])]
        for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True):
            yield ids[a:b]


@lru_cache(1)
def word_ids(path: str) -> WordIds:
    """One per worker process, so that tasks after the first start with its words."""
    return WordIds(path)


def cut_pieces(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """Rows of PIECES: each document's ids and END_ID, cut every `window` ids. Null texts are empty: END_ID alone."""

    @freed
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of, end = word_ids(tokenizer), np.array([END_ID], "<u4").tobytes()
        for b in batches:
            row = 0
            for part in slices(b.column(1), ENCODED_BYTES):
                out: list[tuple] = []
                for ids in ids_of.texts(part):
                    raw = ids.tobytes() + end
                    n = len(raw) // 4
                    out += [(row, s, min(window, n - s), crc32(raw[4 * s : 4 * (s + window)]), n) for s in range(0, n, window)]
                    row += 1
                rows, *rest = zip(*out, strict=True)
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(rows, pa.int64())), *(pa.array(c, pa.int64()) for c in rest)], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    return docs.select(named(id_col).cast("long").alias("doc_id"), named(text_col).alias("text")).mapInArrow(run, PIECES)


def fewest_windows(sizes: list[int], capacity: int) -> int:
    """Windows that are needed at least: of sizes above capacity / (k + 1), a window holds k."""
    ordered = np.sort(np.asarray(sizes, np.int64))
    over = lambda k: len(ordered) - int(np.searchsorted(ordered, capacity // (k + 1), "right"))
    return max(1, -(-int(ordered.sum()) // capacity), *(-(-over(k) // k) for k in range(1, 9)))


def differenced(sizes: list[int], capacity: int) -> list[list[int]]:
    """Indices of sizes (each from 1 to capacity) in near-equal windows of at most capacity, by Karmarkar-Karp differencing.

    Every size starts as a partition with one loaded window. The two partitions of the widest spread are merged, the fullest windows of one
    onto the emptiest of the other, until one is left. If a window then exceeds the capacity, it is done again with more windows: the
    step doubles until all fit, and halving between the last two counts finds a count that fits while one less was too few.
    """
    n = len(sizes)

    def fit(m: int) -> list[list[int]] | None:
        total = _difference(sizes, m) if m < n else [[i] for i in range(n)]
        return total if all(sum(sizes[i] for i in w) <= capacity for w in total) else None

    low = fewest_windows(sizes, capacity) - 1
    step, found = 1, None
    while found is None:
        high = min(low + step, n)
        found = fit(high)
        low, step = (low, step) if found else (high, 2 * step)
    while high - low > 1:
        middle = (low + high) // 2
        if better := fit(middle):
            found, high = better, middle
        else:
            low = middle
    return [w for w in found if w]


def _difference(sizes: list[int], m: int) -> list[list[int]]:
    # A partition: sums in ascending order, and for each window a node; a node is an item (below n) or joins two nodes.
    n = len(sizes)
    left: list[int] = []
    right: list[int] = []
    heap = []
    for i, s in enumerate(sizes):
        sums, nodes = np.zeros(m, np.int64), np.full(m, -1, np.int64)
        sums[-1], nodes[-1] = s, i
        heap.append((-s, i, sums, nodes))
    heapq.heapify(heap)
    for turn in range(n, 2 * n - 1):
        _, _, a, x = heapq.heappop(heap)
        _, _, b, y = heapq.heappop(heap)
        sums, y = a + b[::-1], y[::-1]
        both = np.flatnonzero((x >= 0) & (y >= 0))
        nodes = np.where(x < 0, y, x)
        nodes[both] = np.arange(len(both)) + n + len(left)
        left += x[both].tolist()
        right += y[both].tolist()
        order = np.argsort(sums, kind="stable")
        sums, nodes = sums[order], nodes[order]
        heapq.heappush(heap, (-int(sums[-1] - sums[0]), turn, sums, nodes))
    windows = []
    for node in heap[0][3].tolist():
        items, todo = [], [node] if node >= 0 else []
        while todo:
            k = todo.pop()
            if k < n:
                items.append(k)
            else:
                todo += [left[k - n], right[k - n]]
        windows.append(sorted(items))
    return windows


def pack(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, docs_per_block: int = DOCS_PER_BLOCK) -> DataFrame:
    """Pieces of all documents with sequence_id and offset: PIECES + "sequence_id long, offset long".

    Each id of a document (its text's by `tokenizer`, then END_ID) lies in exactly one piece; sequences hold at most `window`
    ids, and offsets in them have no gaps. Whole windows of long documents are sequences of their own; what is left over
    is spread over near-equal windows by differenced(). Null and empty texts give one piece of one id. Repeated rows are packed as
    rows of their own; an empty table gives no pieces. Columns besides id and text are left out.

    Tokens are counted and hashed where the texts are read; only pieces (numbers) are shuffled, first to count and number those that
    equal another in all, then to blocks of about docs_per_block documents by hash of piece and number. The number of blocks grows with
    the table and equal pieces part company, so no block does grow.
    """
    pieces = cut_pieces(docs, tokenizer, id_col, text_col, window)
    blocks = max(1, docs.count() // docs_per_block)
    own = ("doc_id", "start", "length", "ids_crc32", "doc_tokens")
    numbered = pieces.groupBy(*own).agg(F.count(F.lit(1)).alias("copies")).select(*own, F.explode(F.sequence(F.lit(1).cast("long"), "copies")).alias("copy"))
    placed = numbered.select(*own, F.pmod(F.xxhash64("doc_id", "doc_tokens", "ids_crc32", "start", "copy"), F.lit(blocks)).alias("block"))

    def fill(part: pa.Table) -> pa.Table:
        part = part.sort_by([("doc_id", "ascending"), ("start", "ascending"), ("ids_crc32", "ascending")])
        length = part["length"].to_pylist()
        whole = [i for i, n in enumerate(length) if n == window]
        rest = [i for i, n in enumerate(length) if n < window]
        sequence, offset = [0] * len(length), [0] * len(length)
        windows = [[i] for i in whole] + [[rest[k] for k in w] for w in (differenced([length[i] for i in rest], window) if rest else [])]
        first = part["block"][0].as_py() << 32
        for k, items in enumerate(windows):
            at = 0
            for i in items:
                sequence[i], offset[i] = first + k, at
                at += length[i]
        return part.drop_columns(["block"]).append_column("sequence_id", pa.array(sequence, pa.int64())).append_column("offset", pa.array(offset, pa.int64()))

    return placed.groupBy("block").applyInArrow(fill, PIECES + ", sequence_id long, offset long")


def op2_packing(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(documents(spark, sf_dir).select("doc_id", "text"), public_tokenizers.path("word_bpe_49k.json"))
