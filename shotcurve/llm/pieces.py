"""SentencePiece BPE encoding by a prefix table, and decoding.

A BPE encoding without its last token is the encoding of the text without that
token. So each prefix of a text has one last token, and the table of these is
the whole encoding: an Aho-Corasick automaton gives the pieces that end at a
position, and the one whose neighbour to the left (the last token of the prefix
before it) is compatible is the entry. Ids are then recovered backwards.

Two tokens are compatible if no merge crosses from one to the other when both
are built side by side; that depends on the merges of each alone and the symbols
at their touching edges, and is remembered per pair. A character without a piece
is a token of its own and becomes its bytes.

Texts are cut where no piece reaches across (between two bytes that stand side
by side in no piece), and distinct chunks go through the table together.

For models with BPE merges by score, byte fallback, a space before the text and
unchanged characters otherwise; others are refused. Defined results: a null or
empty text has no ids and decodes to an empty text; null ids decode to an empty
text; repeated rows and null ids of documents are rows like any other; an empty
table gives no rows. A space in a piece may stand for a literal U+2581, which
comes back as a space, as in the library. Other columns may have any name.
"""

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shotcurve.llm import chunks

SPACE = "▁"
# pairs of tokens whose compatibility a worker remembers
REMEMBERED_PAIRS = 1_000_000


class Pieces:
    """Vocabulary of a model file: its pieces, their merges, and the tables made of them."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.vocab_size()
        special = [model.is_control(i) or model.is_unknown(i) for i in range(n)]
        byte = [model.is_byte(i) for i in range(n)]
        self.pieces = ["" if s or b else model.id_to_piece(i) for i, (s, b) in enumerate(zip(special, byte))]
        self.rank = {p: -model.get_score(i) for i, p in enumerate(self.pieces) if p}
        self.byte_ids = {int(model.id_to_piece(i)[1:-1], 16): i for i in range(n) if byte[i]}
        probe = " a  b\t①́ "
        if (len(self.byte_ids) != 256 or any(model.is_unused(i) for i in range(n))
                or model.decode(model.encode(probe)) != probe or model.encode(SPACE + probe) != model.encode(" " + probe)
                or model.encode("") or not model.id_to_piece(model.encode("a"))[0].startswith(SPACE)):
            raise ValueError("not a BPE model with byte fallback, a space in front and unchanged characters")
        self.special = special
        self.edges = {}

    # merges

    def build(self, text: str):
        """The merges of a text in order, each with the symbols then at its left and right edge,
        and the symbols that remain."""
        symbols, steps = list(text), []
        while True:
            best = min(((self.rank[a + b], i) for i, (a, b) in enumerate(zip(symbols, symbols[1:])) if a + b in self.rank),
                       default=None)
            if best is None:
                return steps, symbols
            rank, i = best
            symbols[i:i + 2] = [symbols[i] + symbols[i + 1]]
            steps.append((rank, symbols[0], symbols[-1]))

    def edge(self, token: str):
        found = self.edges.get(token)
        if found is None:
            found = self.edges[token] = self.build(token)[0]
        return found

    def compatible(self, left: str, right: str) -> bool:
        """Whether left and right stay apart when both are built next to each other."""
        none = (float("inf"), "", "")
        a, b = iter(self.edge(left)), iter(self.edge(right))
        x, y = left[0] if len(left) == 1 else left[-1], right[0]
        next_a, next_b = next(a, none), next(b, none)
        while True:
            across = self.rank.get(x + y, none[0])
            # of equal ranks the leftmost merge comes first
            if next_a[0] <= across and next_a[0] <= next_b[0]:
                if next_a is none:
                    return True
                x, next_a = next_a[2], next(a, none)
            elif across <= next_b[0]:
                return False
            else:
                y, next_b = next_b[1], next(b, none)

    # encoding

    def automaton(self):
        """Finds the pieces that end at each position, of those that are their own encoding."""
        import ahocorasick

        found = ahocorasick.Automaton()
        for i, piece in enumerate(self.pieces):
            if piece and (len(piece) == 1 or self.build(piece)[1] == [piece]):
                found.add_word(piece, (i, len(piece)))
        found.make_automaton()
        return found

    def seams(self) -> np.ndarray:
        """seams[x, y]: no piece has byte y after byte x, and y begins a character."""
        free = np.ones((256, 256), bool)
        for piece in self.pieces:
            b = np.frombuffer(piece.replace(SPACE, " ").encode(), np.uint8)
            free[b[:-1], b[1:]] = False
        free[:, 0x80:0xc0] = False
        return free

    def encoder(self):
        """A function from chunks to their ids, as bytes of 32-bit integers."""
        matches, pieces, pairs = self.automaton().iter, self.pieces, {}
        n = len(pieces)

        def last_tokens(text):
            """For each position the id of the last token of the prefix that ends there; -1: its character."""
            last = [-1] * len(text)
            for end, (token, size) in matches(text):
                if last[end] >= 0:
                    continue
                before = end - size
                if before >= 0:
                    left = last[before]
                    key = left * n + token if left >= 0 else (text[before], token)
                    fits = pairs.get(key)
                    if fits is None:
                        fits = pairs[key] = self.compatible(pieces[left] if left >= 0 else text[before], pieces[token])
                    if not fits:
                        continue
                last[end] = token
            return last

        ids = [i.to_bytes(4, "little") for i in range(n)]
        sizes = [len(p) for p in pieces]
        byte = [ids[self.byte_ids[b]] for b in range(256)]

        def encode(new):
            if len(pairs) > REMEMBERED_PAIRS:
                pairs.clear()
            # all chunks in one table; no piece holds the separator
            text = "\0".join(new).replace(" ", SPACE)
            last, found, end = last_tokens(text), [], len(text) - 1
            for chunk in reversed(new):
                start, out = end - len(chunk), []
                while end > start:
                    token = last[end]
                    if token >= 0:
                        out.append(ids[token])
                        end -= sizes[token]
                    else:
                        out += [byte[b] for b in reversed(text[end].encode())]
                        end -= 1
                found.append(b"".join(reversed(out)))
                end -= 1
            return found[::-1]

        if any("\0" in p for p in pieces):
            raise ValueError("a piece holds the separator")
        return encode

    # decoding

    def surfaces(self) -> list[bytes]:
        """The bytes each id stands for; control ids stand for nothing."""
        out = [p.replace(SPACE, " ").encode() for p in self.pieces]
        for b, i in self.byte_ids.items():
            out[i] = bytes([b])
        return out


def utf8(data: bytes) -> str:
    """Text of bytes; each byte that is part of no character becomes U+FFFD."""
    try:
        return data.decode()
    except UnicodeDecodeError as e:
        return data[:e.start].decode() + "�" + utf8(data[e.start + 1:])


def encode(docs: DataFrame, model_path: str) -> DataFrame:
    """doc_id, ids (array of int) of docs (doc_id, text); model_path: a file every executor has."""

    def run(batches):
        import pyarrow as pa

        pieces = Pieces(model_path)
        table = chunks.ChunkIds(pieces.seams(), pieces.encoder(), prefix=" ")
        for batch in batches:
            for start, texts in chunks.slices(batch.column(1)):
                bounds, ids = table.ids(texts)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(start, len(texts)),
                     pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), ids)], names=["doc_id", "ids"])

    return docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"),
        F.translate(F.coalesce(F.col("text"), F.lit("")), SPACE, " ").alias("text"),
    ).mapInArrow(run, "doc_id bigint, ids array<int>")


def decode(encoded: DataFrame, model_path: str) -> DataFrame:
    """doc_id, ids, text of encoded (doc_id, ids): the texts the library's decode gives."""

    def run(batches):
        import pyarrow as pa
        import pyarrow.compute as pc

        pieces = Pieces(model_path)
        surfaces = pa.array(pieces.surfaces(), pa.large_binary())
        silent = np.array([not s for s in pieces.surfaces()])
        byte_ids = np.zeros(len(pieces.pieces), bool)
        byte_ids[list(pieces.byte_ids.values())] = True

        def text_of(ids):
            # one space in front goes, if a piece has it and nothing but control ids comes first
            ids = ids[~silent[ids]]
            data = b"".join(surfaces.take(pa.array(ids)).to_pylist())
            return utf8(data[1:] if len(ids) and not byte_ids[ids[0]] and data[:1] == b" " else data)

        for batch in batches:
            for i in range(0, len(batch), 512):
                part = batch.slice(i, 512)
                ids = pc.fill_null(part.column(1), []) if part.column(1).null_count else part.column(1)
                joined = pc.binary_join(
                    pa.LargeListArray.from_arrays(ids.offsets.cast(pa.int64()), surfaces.take(ids.values)),
                    pa.scalar(b"", pa.large_binary()))
                try:
                    joined = joined.cast(pa.large_string())
                    first = pc.list_element(ids.filter(pc.greater(pc.list_value_length(ids), 0)), 0)
                    plain = not (silent | byte_ids)[first.to_numpy(zero_copy_only=False)].any()
                except pa.ArrowInvalid:
                    plain = False
                if plain:
                    spaced = pc.starts_with(joined, " ")
                    texts = pc.if_else(spaced, pc.utf8_slice_codeunits(joined, 1), joined)
                else:
                    texts = pa.array([text_of(np.array(x, np.int64)) for x in ids.to_pylist()], pa.large_string())
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), ids, texts.cast(pa.string())], names=["doc_id", "ids", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id bigint, ids array<int>, text string")
