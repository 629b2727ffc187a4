"""SentencePiece encoding and decoding over a shared-prefix trie.

Text is marked (a leading space is added, spaces become U+2581) and cut before every mark that
follows another character: no piece of the vocabulary reaches over such a place, which the model
reader checks. The distinct marked words of a share are sorted, which lays them out as a depth-first
walk of their trie, and forward scores are kept on a stack: a word starts from the states of the
prefix that it shares with the word before it.

For a unigram vocabulary the state of a prefix is its best score and last piece (Viterbi). A BPE
vocabulary has no score to add up (on the tables of scale 0.1, adding its scores up encodes 66 % of the distinct
words, 48 % of all, otherwise than the library); its forward state is the last piece of the prefix's own encoding.
Encodings of prefixes nest: the encoding of a word is that of a shorter prefix and one more piece,
and that piece is the only one which merging leaves beside its left neighbour. `joint` decides this
for two pieces by undoing their merges step by step. Characters outside the vocabulary become their
UTF-8 bytes' pieces.

The words of one share are held in memory, SHARE_CHARS of text at most, with a cache of CACHE
encodings; nothing is gathered across shares.

Defined results: a null text encodes like an empty one, to no pieces; decoding gives the text back
exactly, but for U+2581, which comes back as the space it stands for; repeated rows are answered each; an empty table gives an empty result; only doc_id and text
are read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .support import released, table

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
CACHE = 600_000
SHARE_CHARS = 4 << 20
SHORT = (3, 2, 1)
TOKENS = "ids array<int>, n_tokens long, decoded_sha256 string, round_trip boolean"


def read_model(path: str) -> dict:
    """Pieces, scores and types of a SentencePiece model, by the wire format of its protocol buffer."""
    import struct

    with open(path, "rb") as f:
        data = f.read()

    def varint(at):
        value = shift = 0
        while True:
            value |= (data[at] & 127) << shift
            at, shift = at + 1, shift + 7
            if data[at - 1] < 128:
                return value, at

    def fields(at, stop):
        while at < stop:
            key, at = varint(at)
            if key & 7 == 0:
                value, at = varint(at)
            elif key & 7 == 1:
                value, at = data[at : at + 8], at + 8
            elif key & 7 == 5:
                value, at = struct.unpack("<f", data[at : at + 4])[0], at + 4
            else:
                size, at = varint(at)
                value, at = (at, at + size), at + size
            yield key >> 3, value

    pieces, trainer = [], {}
    for number, span in fields(0, len(data)):
        if number == 1:  # piece: 1 text, 2 score, 3 type
            one = dict(fields(*span))
            pieces.append((data[slice(*one[1])].decode(), one.get(2, 0.0), one.get(3, 1)))
        elif number == 2:  # trainer: 3 model type (1 unigram, 2 BPE)
            trainer = dict(fields(*span))
        elif number == 3:  # normaliser: 2 character map, 3 leading space, 4 extra spaces go, 5 spaces become marks
            rule = dict(fields(*span))
            mapped = rule.get(2, (0, 0))
            if mapped[0] != mapped[1] or not rule.get(3, 1) or rule.get(4, 1) or not rule.get(5, 1):
                raise ValueError("only a model that adds a leading space, keeps all spaces as marks and maps no characters is supported")
    if trainer.get(3, 1) not in (1, 2):
        raise ValueError("only unigram and BPE models are supported")
    if any(kind == 4 for _, _, kind in pieces):
        raise ValueError("pieces defined by the user are not supported")
    return {"pieces": pieces, "bpe": trainer.get(3, 1) == 2}


class Pieces:
    """A vocabulary and the encoder over it."""

    NORMAL, UNKNOWN, BYTE = 1, 2, 6

    def __init__(self, model: dict):
        self.text = [p for p, _, _ in model["pieces"]]
        self.score = [s for _, s, _ in model["pieces"]]
        self.bpe = model["bpe"]
        kinds = [k for _, _, k in model["pieces"]]
        self.id = {p: i for i, (p, k) in enumerate(zip(self.text, kinds, strict=True)) if k == self.NORMAL}
        self.bytes = {int(p[3:5], 16): i for i, (p, k) in enumerate(zip(self.text, kinds, strict=True)) if k == self.BYTE}
        self.unknown = kinds.index(self.UNKNOWN)
        self.longest = max(map(len, self.id))
        if any(MARK in p.lstrip(MARK) for p in self.id):
            raise ValueError("a piece goes on over the start of a word")
        self.raw = [b"" if k not in (self.NORMAL, self.BYTE) else bytes([int(p[3:5], 16)]) if k == self.BYTE else p.replace(MARK, " ").encode() for p, k in zip(self.text, kinds, strict=True)]
        self.halves: dict = {}
        self.known: dict = {}
        self.floor = min(self.score) - 10.0
        self.reached = {p for p in self.id if not self.bpe or self.split(p) is not False}
        # By the last three characters, the lengths of the pieces that end so, longest first.
        ends: dict = {}
        for p in self.reached:
            if len(p) > 3:
                ends.setdefault(p[-3:], set()).add(len(p))
        self.lengths = {e: (*sorted(n, reverse=True), *SHORT) for e, n in ends.items()}

    def split(self, piece: str):
        """The two pieces that merging joins last to make piece; None for a character, False if merging does not reach piece."""
        if len(piece) == 1:
            return None
        if piece not in self.halves:
            parts = self.merge(piece)
            self.halves[piece] = parts if parts else False
        return self.halves[piece]

    def merge(self, word: str):
        """Merges the characters of word pair by pair, best score first and leftmost of equals; returns the last pair if one piece is left."""
        parts, last = list(word), None
        while len(parts) > 1:
            found = [(-self.score[self.id[a + b]], i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)) if a + b in self.id]
            if not found:
                return None
            i = min(found)[1]
            last = (parts[i], parts[i + 1])
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return last

    def joint(self, left: str, right: str) -> bool:
        """Whether merging left + right leaves exactly the two pieces, so that they may stand side by side."""
        pair = (left, right)
        if pair in self.known:
            return self.known[pair]
        limit, a, b = None, left, right
        ok = True
        # Undo the latest merge on either side; at no time may a pair over the seam have been due earlier.
        while True:
            over = self.id.get(a + b)
            if over is not None:
                due = self.score[over]
                # The pair over the seam was there while merges worse than `limit` were still to come.
                if limit is None or due > limit[0] or (due == limit[0] and limit[1]):
                    ok = False
                    break
            x, y = self.split(a), self.split(b)
            if not x and not y:
                break
            sa = self.score[self.id[a]] if x else None
            sb = self.score[self.id[b]] if y else None
            if y is None or y is False or (x and sa <= sb):
                # Of equal scores the left merge is made first, so the right one is undone first.
                if x and y and sa == sb:
                    limit, b = (sb, True), y[0]
                else:
                    limit, a = (sa, False), x[1]
            else:
                limit, b = (sb, True), y[0]
        if len(self.known) > 2_000_000:
            self.known.clear()
        self.known[pair] = ok
        return ok

    def encode_words(self, words: list[str]) -> dict[str, tuple[int, ...]]:
        """Encodings of distinct marked words, taken in sorted order over a stack of forward states."""
        out, before = {}, ""
        state: list = [(0.0, None, -1)]  # per prefix: score, last piece, start of it
        step = self._best if not self.bpe else self._last
        for word in sorted(words):
            shared, most = 0, min(len(word), len(before))
            while shared < most and word[shared] == before[shared]:
                shared += 1
            del state[shared + 1 :]
            for end in range(shared + 1, len(word) + 1):
                state.append(step(word, end, state))
            before = word
            ids, end = [], len(word)
            while end:
                _, piece, start = state[end]
                if piece is None:
                    ids += [self.bytes.get(b, self.unknown) for b in reversed(word[start:end].encode("utf-8", "replace"))]
                else:
                    ids.append(self.id[piece])
                end = start
            out[word] = tuple(reversed(ids))
        return out

    def _best(self, word: str, end: int, state: list):
        found = (state[end - 1][0] + self.floor, None, end - 1)
        for start in range(max(0, end - self.longest), end):
            piece = word[start:end]
            if piece in self.id and (state[start][0] + self.score[self.id[piece]]) > found[0]:
                found = (state[start][0] + self.score[self.id[piece]], piece, start)
        return found

    def _last(self, word: str, end: int, state: list):
        """The last piece of the encoding of word[:end]: the longest first, the only one that is joint with what it follows."""
        known, reached = self.known, self.reached
        for length in self.lengths.get(word[max(0, end - 3) : end], SHORT):
            start = end - length
            if start < 0:
                continue
            piece = word[start:end]
            if piece not in reached:
                continue
            before = state[start][1]
            if start == 0 or before is None:
                return (0.0, piece, start)
            ok = known.get((before, piece))
            if self.joint(before, piece) if ok is None else ok:
                return (0.0, piece, start)
        return (0.0, None, end - 1)

    def decode(self, ids) -> str:
        text = b"".join(map(self.raw.__getitem__, ids)).decode("utf-8", "replace")
        return text[1:] if text.startswith(" ") else text


def marked_words(text: str) -> list[str]:
    """The marked words of a text: runs of marks, each with the characters up to the next one."""
    if not text:
        return []
    head, *rest = text.replace(MARK, " ").split(" ")
    words, marks = ([MARK + head], MARK) if head else ([], MARK * 2)
    for k, part in enumerate(rest):
        if part:
            words.append(marks + part)
            marks = MARK
        elif k < len(rest) - 1:
            marks += MARK
        else:
            words.append(marks)
    return words


class Cache:
    """Encodings by word in two generations: a full young one becomes the old one, which is dropped; what is used stays."""

    def __init__(self, pieces: Pieces):
        self.pieces, self.young, self.old = pieces, {}, {}

    def __call__(self, words: set[str]) -> dict:
        """A mapping that has all of words: plain ones (encoded with a mark before them) and marked ones."""
        missing = words.difference(self.young)
        if len(self.young) + len(missing) > CACHE // 2:
            self.old, self.young = self.young, {}
            missing = words
        kept = missing.intersection(self.old)
        self.young.update((w, self.old[w]) for w in kept)
        marked = {w: w if w.startswith(MARK) else MARK + w for w in missing.difference(kept)}
        coded = self.pieces.encode_words(list(set(marked.values())))
        self.young.update((w, coded[m]) for w, m in marked.items())
        return self.young


def cut(text: str) -> list[str]:
    """The words of a text for the cache: plain where single spaces part them, else marked."""
    words = text.split(" ")
    return marked_words(text) if "" in words or MARK in text else words


def _encode(model_path: str):
    def run(batches):
        import hashlib
        from array import array
        from itertools import chain

        import numpy as np
        import pyarrow as pa

        pieces = Pieces(read_model(model_path))
        cache = Cache(pieces)

        def settle(ids_column, texts):
            words = [cut(t) if t else [] for t in texts]
            find = cache(set(chain.from_iterable(words))).__getitem__
            flat, sizes, digest, same = array("i"), [], [], []
            for t, w in zip(texts, words, strict=True):
                ids = array("i", chain.from_iterable(map(find, w)))
                back = pieces.decode(ids)
                flat.extend(ids)
                sizes.append(len(ids))
                same.append(back == t)
                digest.append(hashlib.sha256(back.encode("utf-8", "surrogatepass")).hexdigest())
            stops = np.append(0, np.cumsum(np.array(sizes, np.int64)))
            lists = pa.ListArray.from_arrays(pa.array(stops.astype(np.int32)), pa.array(np.frombuffer(flat, np.int32) if flat else np.zeros(0, np.int32)))
            return pa.RecordBatch.from_arrays([ids_column, lists, pa.array(sizes, pa.int64()), pa.array(digest, pa.string()), pa.array(same, pa.bool_())], names=["doc_id", "ids", "n_tokens", "decoded_sha256", "round_trip"])

        for b in batches:
            texts = [t or "" for t in b.column("text").to_pylist()]
            at = size = 0
            for i, t in enumerate(texts):
                size += len(t)
                if size >= SHARE_CHARS or i == len(texts) - 1:
                    yield settle(b.column("doc_id").slice(at, i + 1 - at), texts[at : i + 1])
                    at, size = i + 1, 0

    return released(run)


def model_path_of(df: DataFrame) -> str:
    """The vocabulary file that the setting graphloom.pieces.model names, or else MODEL."""
    return df.sparkSession.conf.get("graphloom.pieces.model", MODEL)


def encode(docs: DataFrame, model_path: str | None = None) -> DataFrame:
    """doc_id, ids, n_tokens, decoded_sha256 and round_trip (whether decoding gives the text back) of every row."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(_encode(model_path or model_path_of(docs)), "doc_id long, " + TOKENS)


def decode(tokens: DataFrame, model_path: str | None = None) -> DataFrame:
    """doc_id and text of every row of tokens (columns doc_id and ids)."""
    model_path = model_path or model_path_of(tokens)

    def run(batches):
        import pyarrow as pa

        pieces = Pieces(read_model(model_path))
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([pieces.decode(x or []) for x in b.column("ids").to_pylist()], pa.string())], names=["doc_id", "text"])

    return tokens.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def op8_pieces(spark, sf_dir):
    return encode(table(spark, sf_dir, "documents"))
