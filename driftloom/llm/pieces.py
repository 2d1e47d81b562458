"""SentencePiece encoding and decoding with an Aho-Corasick automaton and a single-pass Viterbi."""

import hashlib
import sys
import types
from array import array

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from sentencepiece import sentencepiece_model_pb2

from .common import string_bytes
from .simhash import slices

BLANK = "▁"
#: Pieces' types in a model file. Fixed values of the format.
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2
#: Pairs of pieces that a task remembers; bytes of words and of their ids that it remembers, as new and as many as old;
#: characters of the longest word that it remembers.
PAIRS, REMEMBERED, LONGEST = 400_000, 48 << 20, 48
#: Bytes of text that are encoded at once.
SLICE = 2 << 20


def read_model(path: str) -> dict:
    """What encoding and decoding need of a model file, as plain values that travel with the functions."""
    raw = open(path, "rb").read()
    proto = sentencepiece_model_pb2.ModelProto.FromString(raw)
    norm, kind = proto.normalizer_spec, proto.trainer_spec.model_type
    if norm.precompiled_charsmap or norm.remove_extra_whitespaces or not norm.escape_whitespaces or kind not in (UNIGRAM, BPE):
        raise ValueError("only unigram and BPE models that keep texts as they are (no character map, no removal of spaces) are read")
    sentencepiece.SentencePieceProcessor(model_proto=raw)  # raises if the file is broken
    return {
        "pieces": [p.piece for p in proto.pieces], "scores": [p.score for p in proto.pieces], "types": [p.type for p in proto.pieces],
        "bpe": kind == BPE, "prefix": norm.add_dummy_prefix, "unknown_surface": proto.trainer_spec.unk_surface, "key": hashlib.sha256(raw).hexdigest(),
    }


class Codec:
    """Texts to piece ids and back.

    The automaton reads a text once; at each position its output links give the pieces that end there, and each relaxes
    the best score. In a BPE model a piece may follow another only if merging their characters by score gives just those
    two, which makes the best path the model's own segmentation; in a unigram model any may follow.

    A text falls apart exactly where no piece holds the two characters side by side. Its stretches between such places
    are solved apart: each different one once a slice of texts, the short ones remembered from slice to slice."""

    def __init__(self, model: dict):
        self.pieces, self.scores, self.bpe, self.prefix = model["pieces"], model["scores"], model["bpe"], model["prefix"]
        types = model["types"]
        self.unknown = types.index(UNKNOWN)
        self.bytes_at = {int(p[3:5], 16): i for i, p in enumerate(self.pieces) if types[i] == BYTE}
        usable = [i for i, t in enumerate(types) if t in (NORMAL, USER_DEFINED)]
        self.ids = {self.pieces[i]: i for i in usable}
        self.automaton = ahocorasick.Automaton()
        for i in usable:
            self.automaton.add_word(self.pieces[i], (len(self.pieces[i]), i, self.scores[i]))
        self.automaton.make_automaton()
        self.pairs = {p[k : k + 2] for p in self.ids for k in range(len(p) - 1)}
        self.worst = min((self.scores[i] for i in usable), default=0.0) - 10.0
        # Where a character's last byte and the next one's first byte meet in no piece, a text is cut.
        self.cuts = np.ones((256, 256), bool)
        for pair in self.pairs:
            x, y = (c.encode() for c in pair.replace(BLANK, " "))
            self.cuts[x[-1], y[0]] = False
        self.cuts[:, 0x80:0xC0] = False  # within a character
        self.singles = {p for p in self.ids if len(p) == 1}
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.held = 0
        self.fits: dict[int, bool] = {}
        self.splits: dict[int, tuple | None] = {}
        self.edges: dict[tuple, list] = {}
        raw = [b"" if t == CONTROL else bytes([int(p[3:5], 16)]) if t == BYTE else model["unknown_surface"].encode() if t == UNKNOWN else p.replace(BLANK, " ").encode() for p, t in zip(self.pieces, types)]
        self.body, self.sizes = np.frombuffer(b"".join(raw), np.uint8), np.array([len(x) for x in raw], np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes

    def merged(self, text: str) -> list[str]:
        """Merge the neighbours of the best score, the first of equals, until none is a piece."""
        symbols = list(text)
        while len(symbols) > 1:
            best, at = None, -1
            for k in range(len(symbols) - 1):
                i = self.ids.get(symbols[k] + symbols[k + 1])
                if i is not None and (best is None or self.scores[i] > best):
                    best, at = self.scores[i], k
            if best is None:
                break
            symbols[at : at + 2] = [symbols[at] + symbols[at + 1]]
        return symbols

    def split(self, i: int) -> tuple[int, int] | None:
        """The two pieces whose merging makes piece i last; None if it is one character or isn't made by merging."""
        if i not in self.splits:
            symbols, last = list(self.pieces[i]), None
            while len(symbols) > 1:
                found = [(-self.scores[j], k) for k in range(len(symbols) - 1) if (j := self.ids.get(symbols[k] + symbols[k + 1])) is not None]
                if not found:
                    last = None
                    break
                k = min(found)[1]
                last = (symbols[k], symbols[k + 1])
                symbols[k : k + 2] = [symbols[k] + symbols[k + 1]]
            self.splits[i] = None if last is None else (self.ids.get(last[0]), self.ids.get(last[1]))
        return self.splits[i]

    def edge(self, i: int, right: bool) -> list[tuple[str, float]]:
        """What stands at one end of piece i as it is merged: each symbol, and the score of the merging that ends it."""
        if (i, right) not in self.edges:
            out, now, end = [], i, float("-inf")
            while now is not None:
                out.append((self.pieces[now], end))
                parts = self.split(now)
                end, now = self.scores[now], parts[right] if parts else None
            self.edges[i, right] = out
        return self.edges[i, right]

    def may_follow(self, a: int, b: int) -> bool:
        """Whether merging the characters of a and b never merges across: no pair at their border comes up before one of
        its sides is merged away (of equal scores, the left comes first)."""
        if len(self.fits) > PAIRS:
            self.fits.clear()
        ids, scores, found = self.ids, self.scores, True
        for left, left_end in self.edge(a, True):
            for right, right_end in self.edge(b, False):
                i = ids.get(left + right)
                if i is not None and scores[i] > left_end and scores[i] >= right_end:
                    found = False
        self.fits[a << 24 | b] = found
        return found

    def solve(self, part: str) -> tuple:
        n = len(part)
        if n == 1:
            i = self.ids.get(part)
            return (i,) if i is not None else self.spell(part)
        if not self.singles.issuperset(part):  # characters that are no pieces stand alone
            cuts = [k for k in range(n) if part[k] not in self.singles]
            if self.bpe:
                edges = sorted({0, n, *cuts, *(k + 1 for k in cuts)})
                if len(edges) > 2:
                    return tuple(i for x, y in zip(edges, edges[1:]) for i in self.solve(part[x:y]))
            return self.solve_with_gaps(part)
        last, start, score = [-1] * (n + 1), [0] * (n + 1), [0.0] + [float("-inf")] * n
        bpe, fits = self.bpe, self.fits
        for end, (size, i, s) in self.automaton.iter(part):
            at = end + 1 - size
            total = score[at] + s
            if total > score[end + 1]:
                if bpe and at:
                    fit = fits.get(last[at] << 24 | i)
                    if not (self.may_follow(last[at], i) if fit is None else fit):
                        continue
                score[end + 1], last[end + 1], start[end + 1] = total, i, at
        out, at = [], n
        while at:
            out.append(last[at])
            at = start[at]
        out.reverse()
        return tuple(out)

    def solve_with_gaps(self, part: str) -> tuple:
        """As solve(), of a unigram model, where some character is only found inside longer pieces or in none."""
        n, low = len(part), float("-inf")
        score, last, start = [0.0] + [low] * n, [-1] * (n + 1), [0] * (n + 1)
        ending: list[list] = [[] for _ in range(n + 1)]
        for end, found in self.automaton.iter(part):
            ending[end + 1].append(found)
        for end in range(1, n + 1):
            options = ending[end] if part[end - 1] in self.singles else [*ending[end], (1, -1, self.worst)]
            for size, i, s in options:
                if score[end - size] + s > score[end]:
                    score[end], last[end], start[end] = score[end - size] + s, i, end - size
        out, at = [], n
        while at:
            out.append((last[at],) if last[at] >= 0 else self.spell(part[start[at] : at]))
            at = start[at]
        return tuple(i for x in reversed(out) for i in x)

    def spell(self, text: str) -> tuple:
        if not self.bytes_at:
            return (self.unknown,)
        return tuple(self.bytes_at[b] for b in text.encode())

    def word(self, word: str) -> bytes:
        """The packed ids of a stretch of text, which holds U+2581 for spaces."""
        found = self.older.get(word)
        if found is None:
            found = array("i", self.solve(word) if word.lstrip(BLANK).isascii() else self.cut(word)).tobytes()
        if len(word) <= LONGEST:
            self.held += 4 * len(word) + len(found) + 200  # with what Python adds
            if self.held > REMEMBERED:
                self.known, self.older, self.held = {}, self.known, 0
            self.known[word] = found
        return found

    def cut(self, text: str) -> list[int]:
        """Solve the stretches between characters that no piece holds side by side."""
        out, at, pairs = [], 0, self.pairs
        for k in range(1, len(text) + 1):
            if k == len(text) or text[k - 1 : k + 1] not in pairs:
                out += self.solve(text[at:k])
                at = k
        return out

    def encode_all(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, one after another, and where each text's begin (n + 1 numbers)."""
        data, first = self.prepared(texts)
        edge = np.zeros(len(data), bool)
        if len(data):
            edge[1:] = self.cuts[data[:-1], data[1:]]
            edge[first[:-1][first[:-1] < first[1:]]] = True
        starts = np.flatnonzero(edge)
        offsets = np.append(starts, len(data)).astype(np.int32)
        parts = pa.StringArray.from_buffers(len(starts), pa.py_buffer(offsets), pa.py_buffer(data)).dictionary_encode()
        known = self.known.get
        solved = [known(w) or self.word(w) for w in pc.replace_substring(parts.dictionary, " ", BLANK).to_pylist()]
        flat, counts = np.frombuffer(b"".join(solved), np.int32), np.fromiter(map(len, solved), np.int64, len(solved)) // 4
        which = parts.indices.to_numpy()
        size = counts[which]
        ends = np.cumsum(size)
        begin = (np.cumsum(counts) - counts)[which]
        ids = flat[np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(begin - ends + size, size)]
        return ids, np.append(0, ends)[np.searchsorted(starts, first)]

    def prepared(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The bytes to encode, with spaces where the model has U+2581, and where each text's begin; nulls are empty."""
        texts = pc.replace_substring(texts.cast(pa.large_string()).fill_null(""), BLANK, " ")
        if self.prefix:
            texts = pc.if_else(pc.equal(texts, ""), texts, pc.binary_join_element_wise(pa.scalar("", pa.large_string()), texts, pa.scalar(" ", pa.large_string())))
        return string_bytes(texts)

    def encode(self, text: str) -> np.ndarray:
        return self.encode_all(pa.array([text], pa.large_string()))[0]

    def raw(self, ids: np.ndarray) -> np.ndarray:
        """The bytes that ids stand for."""
        size = self.sizes[ids]
        ends = np.cumsum(size)
        return self.body[np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(self.starts[ids] - ends + size, size)]

    def decode(self, ids: np.ndarray) -> str:
        text = self.raw(np.asarray(ids, np.int64)).tobytes().decode("utf-8", "replace")
        return text[1:] if self.prefix and text[:1] == " " else text

    def round_trips(self, texts: pa.Array, ids: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Whether each text's ids decode to the text itself, character by character: all are decoded at once, and those
        that don't give the bytes that were encoded once more by decode()."""
        data, at = self.prepared(texts)
        body, size = self.raw(ids), np.append(0, np.cumsum(self.sizes[ids]))[first]
        same = np.diff(size) == np.diff(at)
        if same.all():
            wrong = np.flatnonzero(body != data)
            same[np.unique(np.searchsorted(at, wrong, side="right") - 1)] = False
        else:
            same[:] = False
        same &= ~np.asarray(pc.match_substring(texts.fill_null(""), BLANK).to_numpy(zero_copy_only=False), bool)
        for k in np.flatnonzero(~same):
            same[k] = self.decode(ids[first[k] : first[k + 1]]) == (texts[k].as_py() or "")
        return same


def codec_for(model: dict) -> Codec:
    """This worker's codec: kept beside the tasks, so that what one task has solved serves the next."""
    state = sys.modules.setdefault("driftloom_worker_state", types.ModuleType("driftloom_worker_state"))
    if getattr(state, "codec_key", None) != model["key"]:
        state.codec, state.codec_key = Codec(model), model["key"]
    return state.codec


def encode_pieces(docs: DataFrame, model_path: str, text_col: str = "text", check: bool = True) -> DataFrame:
    """docs with ids (array of piece ids of the whole text), n_tokens and, with check, round_trip.

    round_trip tells whether the ids decode to the text itself; it is false for a text that holds U+2581, which the format
    takes for a space. Null and empty texts have no ids and round-trip as empty. Repeated rows are encoded alike, an empty
    table gives an empty result; columns of docs with the new names are replaced. The model's tables travel with the tasks;
    its file need not be on the executors."""
    model = read_model(model_path)
    new = ["ids", "n_tokens", *(["round_trip"] if check else [])]
    own = [c for c in docs.columns if c not in new]

    def run(batches):
        codec = codec_for(model)
        for batch in batches:
            for part in slices(batch, text_col, SLICE):
                texts = part.column(text_col)
                ids, first = codec.encode_all(texts)
                listed = pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.array(ids))
                cols = [part.column(c) for c in own] + [listed, pa.array(np.diff(first).astype(np.int32))] + ([pa.array(codec.round_trips(texts, ids, first))] if check else [])
                yield pa.RecordBatch.from_arrays(cols, [*own, *new])
            pa.default_memory_pool().release_unused()

    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*own).schema] + ["ids array<int>", "n_tokens int", *(["round_trip boolean"] if check else [])]
    return docs.select(*(F.col(f"`{c}`") for c in own)).mapInArrow(run, ", ".join(fields))


def decode_pieces(coded: DataFrame, model_path: str, ids_col: str = "ids") -> DataFrame:
    """coded with decoded, the text of its ids; null ids are null."""
    model = read_model(model_path)
    own = [c for c in coded.columns if c != "decoded"]

    def run(batches):
        codec = codec_for(model)
        for batch in batches:
            texts = [None if x is None else codec.decode(x) for x in batch.column(ids_col).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in own), pa.array(texts, pa.string())], [*own, "decoded"])

    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in coded.select(*own).schema] + ["decoded string"]
    return coded.select(*own).mapInArrow(run, ", ".join(fields))
