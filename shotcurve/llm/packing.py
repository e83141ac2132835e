"""Cost-balanced packing of documents into training sequences.

Every task tokenizes its documents and packs them window by window (a window
is a bounded number of tokens), so nothing is shuffled, memory does not depend
on the input, and a document repeated any number of times is no hot spot.

In a window the cost of a piece is estimated as linear * n + quadratic * n^2
(attention). Pieces, longest first, go to the sequence with the lowest cost so
far that still has room. What then fits nowhere is cut to fill the room left.
A window's tokens fill its sequences exactly: as many of full length as
possible, and the rest in sequences whose lengths are powers of two, which need
no padding.

Defined results: a null or empty text is a document of the end token alone;
repeated rows are packed once each; a document longer than a sequence is cut;
an empty table gives no rows; null doc_ids stay null, each row being a document of
its own. Equal lengths are packed in the order of their rows. Only doc_id and text
are read, other columns may have any name. Output per piece: doc_id, start, length, doc_tokens,
sequence_id, offset, ids (unsigned little-endian 32-bit). sequence_id holds the
number of the task that packed it in its upper half.
"""

import heapq
import re

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shotcurve.llm import chunks

SEQUENCE_TOKENS = 4096
WINDOW_TOKENS = 1 << 21
END_ID = 2
LINEAR, QUADRATIC = 1.0, 1.0 / 1024
# pieces of words whose ids a worker remembers
PIECE_CACHE = 400_000
# ASCII marks that begin no contraction
MARKS = ".,;:!?()\"-"
CONTROL = re.compile("[\x1c-\x1f]")
SPACE = re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+")

SCHEMA = ("doc_id bigint, start bigint, length bigint, doc_tokens bigint, "
          "sequence_id bigint, offset bigint, ids binary")


def sequence_room(total: int, size: int) -> tuple[int, list[int]]:
    """Number of full sequences, and the powers of two that make up the rest."""
    full, rest = divmod(total, size)
    return full, [1 << b for b in reversed(range(rest.bit_length())) if rest >> b & 1]


def plan_window(lengths: list[int], size: int = SEQUENCE_TOKENS, linear: float = LINEAR,
                quadratic: float = QUADRATIC) -> list[tuple[int, int, int, int, int]]:
    """(document, start, length, sequence, offset) of the pieces of one window."""
    full, short = sequence_room(sum(lengths), size)
    room = [size] * full + short
    cost = [0.0] * len(room)
    placed = []

    def put(doc, start, n, seq, capacity):
        placed.append((doc, start, n, seq, capacity - room[seq]))
        room[seq] -= n
        cost[seq] += linear * n + quadratic * n * n

    pieces = sorted(((min(size, n - s), i, s) for i, n in enumerate(lengths) for s in range(0, n, size)),
                    key=lambda p: (-p[0], p[1], p[2]))
    cheapest = [(0.0, j) for j in range(full)]
    left = []
    for n, doc, start in pieces:
        aside = []
        while cheapest and room[cheapest[0][1]] < n:
            aside.append(heapq.heappop(cheapest))
        if cheapest:
            j = cheapest[0][1]
            put(doc, start, n, j, size)
            if room[j]:
                heapq.heapreplace(cheapest, (cost[j], j))
            else:
                heapq.heappop(cheapest)
        else:
            left.append((n, doc, start))
        for entry in aside:
            heapq.heappush(cheapest, entry)

    # cut what is left into the room that is left, cheapest sequences first
    for cap, j in zip(short, range(full, len(room))):
        heapq.heappush(cheapest, (0.0, j))
    for n, doc, start in left:
        while n:
            j = cheapest[0][1]
            take = min(n, room[j])
            put(doc, start, take, j, size if j < full else short[j - full])
            start, n = start + take, n - take
            if room[j]:
                heapq.heapreplace(cheapest, (cost[j], j))
            else:
                heapq.heappop(cheapest)
    return placed


class WordIds:
    """Ids of texts by way of words: the encoder of chunks.ChunkIds.

    For tokenizers of the form "normalize, drop white space, split by a
    pattern, byte-level BPE": no token crosses white space, so texts may be cut
    there, and only a new word is normalized, split and merged by the
    tokenizer's own parts. Pieces beyond a bound are forgotten."""

    def __init__(self, path: str):
        import json

        import regex
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            config = json.load(f)
        split, level = config["pre_tokenizer"]["pretokenizers"]
        if (split["type"], split["invert"], split["behavior"], level["type"], level["use_regex"]) != (
                "Split", True, "Removed", "ByteLevel", False):
            raise ValueError("not a tokenizer that splits by a pattern and drops white space")
        self.find = regex.compile(split["pattern"]["Regex"]).findall
        self.special = [t["content"] for t in config["added_tokens"]]
        self.model = self.tokenizer.model
        self.pieces = {}
        # byte-level alphabet: printable bytes stand for themselves, the others
        # for the characters from 256 on
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        self.letters = {b: 256 + i for i, b in enumerate(b for b in range(256) if b not in plain)}

    def seams(self) -> np.ndarray:
        """Cuts between white space and words, and between ASCII letters and the marks that the
        pattern takes for words of their own; none inside special tokens."""
        space, letter, mark = np.zeros((3, 256), bool)
        space[[*range(9, 14), 32]] = True
        letter[[*range(65, 91), *range(97, 123)]] = True
        mark[[ord(m) for m in MARKS if self.find(f"a{m}b") == ["a", m, "b"]]] = True
        sides = [(~space, space), (space, ~space), (letter, mark), (mark, letter)]
        free = np.logical_or.reduce([left[:, None] & right for left, right in sides])
        for token in self.special:
            b = list(token.encode())
            free[b[:-1], b[1:]] = False
        return free

    def word(self, word: str) -> bytes:
        if any(s in word for s in self.special):
            return b"".join(i.to_bytes(4, "little") for i in self.tokenizer.encode(word, add_special_tokens=False).ids)
        # Latin letters are composed as they are and have one lower case
        low = word.lower() if max(word) < "\u0250" else self.tokenizer.normalizer.normalize_str(word)
        return b"".join(map(self.piece, [low] if low.isalpha() else self.find(low)))

    def piece(self, text: str) -> bytes:
        ids = self.pieces.get(text)
        if ids is None:
            letters = text.encode("utf-8").decode("latin-1").translate(self.letters)
            ids = b"".join(t.id.to_bytes(4, "little") for t in self.model.tokenize(letters))
            self.pieces[text] = ids
        return ids

    def encode(self, text: str) -> bytes:
        # split() also cuts at four control characters which are not white space
        words = SPACE.split(text) if CONTROL.search(text) else text.split()
        return b"".join([self.word(w) for w in words if w])

    def encode_all(self, texts: list[str]) -> list[bytes]:
        if len(self.pieces) > PIECE_CACHE:
            self.pieces.clear()
        return [self.encode(t) for t in texts]


def pack(docs: DataFrame, tokenizer_path: str, size: int = SEQUENCE_TOKENS, end_id: int = END_ID,
         window_tokens: int = WINDOW_TOKENS, linear: float = LINEAR,
         quadratic: float = QUADRATIC) -> DataFrame:
    """Pieces of all docs (doc_id, text); see the module for the columns.

    tokenizer_path: a file every executor has, of a tokenizer that drops white
    space. A lost task packs its own documents again, with the same result."""

    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        encoder = WordIds(tokenizer_path)
        table = chunks.ChunkIds(encoder.seams(), encoder.encode_all)
        end = end_id.to_bytes(4, "little")
        sequence = TaskContext.get().partitionId() << 32
        doc_ids, docs_ids, tokens = [], [], 0

        def flush():
            nonlocal sequence
            lengths = [len(b) // 4 for b in docs_ids]
            placed = plan_window(lengths, size, linear, quadratic)
            first, sequence = sequence, sequence + 1 + max(p[3] for p in placed)
            for i in range(0, len(placed), 4096):
                part = placed[i:i + 4096]
                yield pa.RecordBatch.from_arrays([
                    pa.array([doc_ids[p[0]] for p in part], pa.int64()),
                    pa.array([p[1] for p in part], pa.int64()),
                    pa.array([p[2] for p in part], pa.int64()),
                    pa.array([lengths[p[0]] for p in part], pa.int64()),
                    pa.array([first + p[3] for p in part], pa.int64()),
                    pa.array([p[4] for p in part], pa.int64()),
                    pa.array([docs_ids[p[0]][4 * p[1]:4 * (p[1] + p[2])] for p in part], pa.binary()),
                ], names=["doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "ids"])

        for batch in batches:
            for start, texts in chunks.slices(batch.column(1)):
                bounds, ids = table.ids(texts)
                raw, bounds = ids.to_numpy().tobytes(), (4 * bounds).tolist()
                for i, doc_id in enumerate(batch.column(0).slice(start, len(texts)).to_pylist()):
                    doc_ids.append(doc_id)
                    docs_ids.append(raw[bounds[i]:bounds[i + 1]] + end)
                    tokens += len(docs_ids[-1]) // 4
                    if tokens >= window_tokens:
                        yield from flush()
                        doc_ids, docs_ids, tokens = [], [], 0
        if doc_ids:
            yield from flush()

    return docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text")
    ).mapInArrow(run, SCHEMA)


def padding(pieces: DataFrame, size: int = SEQUENCE_TOKENS) -> DataFrame:
    """sequences, tokens and padding of packed pieces."""
    lengths = pieces.groupBy("sequence_id").agg(F.sum("length").alias("n"))
    exact = F.bit_count("n") == 1
    return lengths.agg(
        F.count("n").alias("sequences"), F.sum("n").alias("tokens"),
        F.sum(F.when(exact, 0).otherwise(size - F.col("n"))).alias("padding"))
