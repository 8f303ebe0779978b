"""Exact token counts and ids of whole texts with public tokenizers.

Byte-level BPE splits a text by a fixed pattern before it merges anything.  No
alternative of that pattern holds a visible character followed by white space,
so every place where a space follows a visible character ends a match whatever
stands around it.  Two things rest on that proof:

* :class:`UnitEncoder` cuts texts there, and lets the library encode each
  distinct unit once per worker (a bounded memo);
* :func:`resynchronised` splices the encodings of overlapping chunks there.
"""

from __future__ import annotations

import json
import os
import string
from array import array
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SOLID = frozenset(string.ascii_letters + string.digits + string.punctuation)
BYTE_SPACE = "\u0120"  # how byte-level vocabularies spell a space
#: Letters that every Unicode version calls letters, and then ASCII marks but the apostrophe, which may open a suffix.
LETTERS, MARKS = "[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+", r"[!-&(-/:-@\[-`{-~]*"
#: Such words, one a line: each word, its run of marks and each line feed are one match of the splitting pattern.
PLAIN = f"^{LETTERS}{MARKS}(?:\n{LETTERS}{MARKS})*$"
WORD_AND_MARKS = f"^(?P<word>{LETTERS})(?P<marks>{MARKS})$"
MEMO_UNITS = 600_000
#: Texts, and their bytes, whose distinct units are looked up together.
TOGETHER, TOGETHER_BYTES = 8_192, 10 << 20


def is_solid(ch: str) -> bool:
    """Surely not white space, in whatever Unicode version a library has."""
    return ch in SOLID or ch.isalnum()


SOLID_BYTES = np.array([chr(x) in SOLID for x in range(128)] + [False] * 128)


def _closed(units: pa.Array, texts: list[str]) -> np.ndarray:
    """Which units end in a visible character; the last byte tells unless it is beyond ASCII."""
    ends = np.frombuffer(units.buffers()[1], dtype=np.int64, count=len(units) + 1 + units.offset)[units.offset :]
    data, sizes = np.frombuffer(units.buffers()[2] or b"", dtype=np.uint8), np.diff(ends)
    last = np.zeros(len(units), dtype=np.uint8)
    last[sizes > 0] = data[ends[1:][sizes > 0] - 1]
    closed = SOLID_BYTES[last]
    for k in np.flatnonzero(last > 127).tolist():
        closed[k] = is_solid(texts[k][-1])
    return closed


class UnitEncoder:
    """Encodes texts with one tokenizer file; ``.json`` or ``.model``.

    The memo has two generations of at most ``memo_units`` entries each, so its
    memory is bounded whatever the vocabulary of the corpus.  Tokenizers whose
    splitting isn't the proven one encode whole texts without a memo.
    """

    def __init__(self, path: str, memo_units: int = MEMO_UNITS):
        self.memo_units, self.memo, self.old = memo_units, {}, {}
        self.sentence_piece = path.endswith(".model")
        if self.sentence_piece:
            import sentencepiece

            self.tool, self.stable = sentencepiece.SentencePieceProcessor(model_file=path), False
            self.dtype = self._id_type(self.tool.get_piece_size())
        else:
            os.environ["TOKENIZERS_PARALLELISM"] = "false"
            from tokenizers import Tokenizer

            self.tool = Tokenizer.from_file(path)
            self.tool.no_truncation()
            self.tool.no_padding()
            self.dtype = self._id_type(self.tool.get_vocab_size())
            self.stable = self._splits_as_proven(json.loads(self.tool.to_str()))
            #: Bytes without a printable Latin-1 sign are spelled by the signs from 256 on, in order.
            signs = [*range(33, 127), *range(161, 173), *range(174, 256)]
            others = [x for x in range(256) if x not in signs]
            self.byte_names = dict(zip(signs, signs, strict=True)) | {x: 256 + k for k, x in enumerate(others)}
            self.bare = Tokenizer(self.tool.model)  # merges alone: its input is split already
            self.opens = np.zeros(self.tool.get_vocab_size(), dtype=bool)
            self.opens[[i for x, i in self.tool.get_vocab().items() if x.startswith(BYTE_SPACE)]] = True

    @staticmethod
    def _id_type(n: int) -> np.dtype:
        return np.dtype("<u4" if n > 1 << 16 else "<u2")

    @staticmethod
    def _splits_as_proven(spec: dict) -> bool:
        first = spec.get("pre_tokenizer") or {}
        return (
            spec.get("normalizer") is None
            and first.get("type") == "ByteLevel"
            and first.get("use_regex", True)
            and not first.get("add_prefix_space")
            and not any(x["lstrip"] or x["rstrip"] or x["single_word"] or any(c.isspace() for c in x["content"]) for x in spec["added_tokens"])
        )

    def encode_whole(self, text: str) -> list[int]:
        if self.sentence_piece:
            return self.tool.encode(text, num_threads=1)
        return self.tool.encode(text, add_special_tokens=False).ids

    def spans(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Starts and ends of the tokens, in code points."""
        offsets = np.array(self.tool.encode(text, add_special_tokens=False).offsets, dtype=np.int64).reshape(-1, 2)
        return offsets[:, 0], offsets[:, 1]

    def _packed(self, unit: str) -> bytes:
        return array(self.dtype.char, self.encode_whole(unit)).tobytes()

    def _learn(self, pieces: list[str]) -> list[bytes]:
        """The ids of distinct closed pieces after a space, in their order; they go into the memo."""
        packed = list(map(self.old.get, pieces))
        new = np.flatnonzero(np.fromiter((x is None for x in packed), dtype=bool, count=len(packed)))
        if len(new):
            texts = pa.array(pieces, pa.large_string()).take(pa.array(new))
            plain = pc.match_substring_regex(texts, PLAIN).to_numpy(zero_copy_only=False)
            for chosen, encode in ((plain, self._encoded_plain), (~plain, self._encoded_rest)):
                if chosen.any():
                    for k, ids in zip(new[chosen].tolist(), self._shared_out(encode(texts.filter(pa.array(chosen)))), strict=True):
                        packed[k] = ids
        if len(self.memo) + len(pieces) > self.memo_units:
            self.memo, self.old = {}, self.memo
        if len(pieces) <= self.memo_units:
            self.memo.update(zip(pieces, packed, strict=True))
        return packed

    def _encoded_plain(self, texts: pa.Array) -> list[int]:
        """The ids of plain units after a space, whose matches are known, so that merges alone are left."""
        lines = pc.split_pattern(texts, "\n")
        parts = pc.extract_regex(lines.values, WORD_AND_MARKS)
        words, marks = pc.struct_field(parts, "word"), pc.struct_field(parts, "marks")
        later, marked = np.ones(len(words), dtype=bool), pc.not_equal(marks, "").to_numpy(zero_copy_only=False)
        later[lines.offsets.to_numpy()[:-1]] = False
        spelt = np.array(words.to_pylist(), dtype=object)
        for k in np.flatnonzero(~pc.string_is_ascii(words).to_numpy(zero_copy_only=False)).tolist():
            spelt[k] = spelt[k].encode().decode("latin-1").translate(self.byte_names)
        spelt[~later] = BYTE_SPACE + spelt[~later]
        n = 1 + later + marked
        at = np.cumsum(n) - n + later
        matches = np.empty(int(n.sum()), dtype=object)
        matches[at] = spelt
        matches[at[later] - 1] = chr(self.byte_names[ord("\n")])
        matches[at[marked] + 1] = marks.filter(pa.array(marked)).to_pylist()
        return self.bare.encode_batch_fast([matches.tolist()], is_pretokenized=True, add_special_tokens=False)[0].ids

    def _encoded_rest(self, texts: pa.Array) -> list[int]:
        return self.tool.encode_batch_fast([" " + " ".join(texts.to_pylist())], add_special_tokens=False)[0].ids

    def _shared_out(self, encoded: list[int]) -> list[bytes]:
        """A piece holds no space, so the tokens that begin with one begin the units."""
        ids = np.array(encoded, dtype=self.dtype)
        cuts = (np.flatnonzero(self.opens[ids]) * self.dtype.itemsize).tolist()
        whole = ids.tobytes()
        return [whole[a:b] for a, b in zip(cuts, [*cuts[1:], ids.nbytes], strict=True)]

    def _open_text(self, text: str) -> bytes:
        """Pieces that end in white space stay with what follows them."""
        units, held = [], None
        for piece in text.split(" "):
            held = piece if held is None else f"{held} {piece}"
            if held and is_solid(held[-1]):
                units.append(held)
                held = None
        if held is not None:
            units.append(held)
        return b"".join(self._packed(x if k == 0 else " " + x) for k, x in enumerate(units))

    def encode_many(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts one after the other, and where each text's begin and end.

        Pieces of all texts are numbered at once, so that the memo is asked once
        for each distinct piece of the batch.
        """
        done = [None] * len(texts)
        if not self.stable:
            return self._joined([self._packed(x) for x in texts])
        pieces = pc.split_pattern(pa.array(texts, pa.large_string()), " ")
        bounds = pieces.offsets.to_numpy()
        coded = pieces.values.dictionary_encode()
        codes, units = coded.indices.to_numpy(), coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        firsts, lasts = bounds[:-1], bounds[1:] - 1
        closed = _closed(coded.dictionary, units)
        inner = closed[codes]
        inner[lasts] = True
        good = np.logical_and.reduceat(inner, firsts) if len(texts) else np.zeros(0, dtype=bool)
        for k in np.flatnonzero(~good).tolist():
            done[k] = self._open_text(texts[k])
        packed = self._packed_units(units, closed)
        sizes = np.fromiter(map(len, packed), dtype=np.int64, count=len(units)) // self.dtype.itemsize
        flat = np.frombuffer(b"".join(packed), dtype=self.dtype)
        rest = np.ones(len(codes), dtype=bool)
        rest[firsts] = False
        codes = codes[rest]
        bounds = bounds - np.arange(len(bounds))
        reps = sizes[codes]
        after = np.concatenate([[0], np.cumsum(reps)])
        narrow = np.int32 if max(after[-1], len(flat)) < 1 << 31 else np.int64
        shifts = ((np.cumsum(sizes) - sizes)[codes] - after[:-1]).astype(narrow)
        ids = flat.take(np.repeat(shifts, reps) + np.arange(after[-1], dtype=narrow))
        for k, (a, b, text) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist(), texts, strict=True)):
            if done[k] is None:
                done[k] = self._packed(text[: text.index(" ")] if b > a else text) + ids[after[a] : after[b]].tobytes()
        return self._joined(done)

    def _packed_units(self, units: list[str], closed: np.ndarray) -> list[bytes]:
        """The ids of each unit after a space; open ones, which end texts, aren't kept."""
        found = list(map(self.memo.get, units))
        gaps = np.flatnonzero(np.fromiter((x is None for x in found), dtype=bool, count=len(found)))
        ended = gaps[closed[gaps]].tolist()
        for k, ids in zip(ended, self._learn([units[k] for k in ended]), strict=True):
            found[k] = ids
        for k in gaps[~closed[gaps]].tolist():
            found[k] = self._packed(f" {units[k]}")
        return found

    def _joined(self, packed: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        sizes = np.fromiter(map(len, packed), dtype=np.int64, count=len(packed)) // self.dtype.itemsize
        return np.frombuffer(b"".join(packed), dtype=self.dtype), np.concatenate([[0], np.cumsum(sizes)])

    def count(self, text: str) -> int:
        return len(self.encode_many([text])[0])


def resynchronised(text: str, spans: Callable[[str], tuple[np.ndarray, np.ndarray]], chunk: int, overlap: int) -> tuple[int, int]:
    """Tokens of a huge text, and the number of chunks that were encoded.

    Each chunk overlaps the one before.  A splice point is a place in the overlap
    that no token of either encoding crosses and where a space follows a visible
    character.  Where an overlap has none it is doubled; when it reaches the last
    splice point, both chunks become one larger chunk.
    """
    low, high, proven = 0, min(chunk, len(text)), 0
    starts, ends = spans(text[low:high])
    total, encoded = 0, 1
    while high < len(text):
        width, splice = overlap, None
        while True:
            begin = max(high - width, proven)
            far = min(len(text), max(begin + chunk, high + overlap))
            next_starts, next_ends = spans(text[begin:far])
            encoded += 1
            if begin == proven:  # the new chunk starts where the last splice was proven
                splice = proven
                break
            splice = _common(text, begin, high, (starts + low, ends + low), (next_starts + begin, next_ends + begin))
            if splice is not None:
                break
            width *= 2
        at = starts + low
        total += int(((at >= proven) & (at < splice)).sum())
        low, high, proven, starts, ends = begin, far, splice, next_starts, next_ends
        if begin == splice and high - low > chunk:
            chunk = max(chunk, 2 * (high - low)) if _common(text, low, high, (starts + low, ends + low), (starts + low, ends + low)) is None else chunk
    return total + int((starts + low >= proven).sum()), encoded


def _common(text: str, begin: int, end: int, left: tuple, right: tuple) -> int | None:
    """The last stable place strictly inside [begin, end) that both encodings have."""
    p = text.rfind(" ", begin + 1, end)
    while p > begin:
        if is_solid(text[p - 1]) and all(_whole(starts, ends, p) for starts, ends in (left, right)):
            return p
        p = text.rfind(" ", begin + 1, p)
    return None


def _whole(starts: np.ndarray, ends: np.ndarray, p: int) -> bool:
    k = int(np.searchsorted(starts, p))
    return k == 0 or int(ends[k - 1]) <= p


_ENCODERS: dict[str, UnitEncoder] = {}


def encoder(path: str) -> UnitEncoder:
    """One encoder, with its memo, per worker process and file."""
    if path not in _ENCODERS:
        _ENCODERS[path] = UnitEncoder(path)
    return _ENCODERS[path]
