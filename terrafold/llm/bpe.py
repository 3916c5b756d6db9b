"""Whole texts to token ids, equal to the tokenizers library's encode(text, add_special_tokens=False) on the whole text.

Not every text goes through that call. Both public BPE files split a text before they merge, and a run of blanks or line
feeds that follows another character always begins a new piece. So a text may be cut there: each different piece is
encoded once per Python worker (plain words by the library's BPE model alone, all else by the whole call) and the ids are
joined by a dictionary lookup. Whole texts go to the library where this rule doesn't hold: texts with other white space or with
an added token's string (which then is that token, as the library has it), and every text of a tokenizer file whose
normaliser, pre-tokeniser or model settings aren't those of the two files.

``column`` does the same for a column of texts: they are cut together, on their bytes, and each different piece of the column is
looked up once, however often it stands there. For the byte-level file it also cuts where a letter is followed by an ASCII mark:
there too a piece always ends, so a word is one entry with and without its marks.
"""

from __future__ import annotations

import json
import re
from array import array

import numpy as np
import pyarrow as pa

#: Pieces that one worker keeps (about 200 bytes each), half of them from before the last change of generation.
MEMO = 800_000

_CUT = re.compile(r"[ \n]*[^ \n]+|[ \n]+")
_LATIN, _MARKS = re.compile("[A-Za-zÀ-ÖØ-öø-ÿ]+"), ".,!?;:"
_OTHER_SPACE = re.compile(r"[^\S \n]|[\x1c-\x1f\x85]")
#: Kinds of bytes: others, blanks, letters and marks of ASCII.
_OTHER, _BLANK, _LETTER, _MARK = range(4)
_KIND = np.array([_BLANK if b in b" \n" else _LETTER if chr(b).isalpha() and b < 128 else _MARK if 32 < b < 127 and not chr(b).isalnum() else _OTHER for b in range(256)], np.uint8)

#: The settings under which texts may be cut, as tokenizer files write them.
_BYTES = (None, {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}, None)
_WORDS = (
    {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]},
    {"type": "Sequence", "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]},
    "</w>",
)
_NO_OTHER = ("dropout", "unk_token", "continuing_subword_prefix", "fuse_unk", "byte_fallback", "ignore_merges")


def _byte_letters() -> dict[int, int]:
    """The letters by which byte-level BPE files write the 256 bytes: printable ones stand for themselves, the rest follow from 256."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in own]
    return {b: b for b in own} | {b: 256 + i for i, b in enumerate(rest)}


class Encoder(dict):
    """Piece -> its ids as little-endian unsigned 32-bit integers."""

    def __init__(self, path: str, memo: int = MEMO):
        from tokenizers import Tokenizer

        super().__init__()
        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.old: dict[str, bytes] = {}
        self.memo = memo
        self.letters = _byte_letters()
        with open(path, encoding="utf-8") as f:
            said = json.load(f)
        model, added = said["model"], said.get("added_tokens") or []
        kind = (said.get("normalizer"), said.get("pre_tokenizer"), model.get("end_of_word_suffix"))
        self.words = kind == _WORDS
        plain = not any(model.get(k) for k in _NO_OTHER) and not any(t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"] for t in added)
        self.cuts = kind in (_BYTES, _WORDS) and model.get("type") == "BPE" and plain and not said.get("post_processor") and not said.get("truncation")
        self.added = [t["content"] for t in added]

    def whole(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def _letters(self, piece: str) -> bytes:
        if self.words:
            piece = piece.lower()
        written = piece.replace(" ", "Ġ") if piece.isascii() else piece.encode().decode("latin-1").translate(self.letters)
        return array("I", [t.id for t in self.model.tokenize(written)]).tobytes()

    def _word(self, gap: str, letters: str) -> bytes:
        if gap == "\n" and not self.words:
            return self["\n"] + self[letters]
        return self._letters(letters if self.words else gap + letters)

    def _encoded(self, piece: str) -> bytes:
        gap = piece[0] if piece[:1] in (" ", "\n") else ""
        bare = piece[1:] if gap else piece
        if bare.isalpha() and (bare.isascii() or _LATIN.fullmatch(bare)):
            return self._word(gap, bare)
        letters = bare.rstrip(_MARKS)
        if not piece:
            return b""
        if not letters.isalpha() or not (letters.isascii() or _LATIN.fullmatch(letters)):
            return self.whole(piece)
        key, end = gap + letters, bare[len(letters) :]
        own = self.get(key) or self.old.get(key)
        if own is None:
            own = self[key] = self._word(gap, letters)
        tail = self.get(end)
        if tail is None:
            tail = self[end] = self.whole(end)
        return own + tail

    def __missing__(self, piece: str) -> bytes:
        value = self.old.get(piece)
        if value is None:
            value = self._encoded(piece)
        if len(self) >= self.memo // 2:  # what is still in use comes back from the old generation
            self.old = dict(self)
            self.clear()
        self[piece] = value
        return value

    def _stays_whole(self, text: str) -> bool:
        if not self.cuts or any(t in text for t in self.added):
            return True
        return not self.words and not text.replace("\n", "").isprintable() and bool(_OTHER_SPACE.search(text))

    def encode(self, text: str | None) -> bytes:
        if not text:
            return b""
        if self._stays_whole(text):
            return self.whole(text)
        if self.words:
            return b"".join(map(self.__getitem__, text.replace("\n", " ").split(" ")))
        if "  " in text or " \n" in text or "\n " in text or "\n\n" in text or text[0] in " \n" or text[-1] in " \n" or "\x00" in text or "\x01" in text:
            return b"".join(map(self.__getitem__, _CUT.findall(text)))
        # The same pieces, found faster: each word takes the blank or line feed before it.
        return b"".join(map(self.__getitem__, text.replace("\n", " \x00").replace(" ", "\x01 ").replace(" \x00", "\n").split("\x01")))

    def column(self, texts: pa.Array) -> list[np.ndarray]:
        """``encode`` of each text, as unsigned 32-bit integers. All its memory is in proportion to the column: give it slices."""
        said = [t or "" for t in texts.to_pylist()]
        if self.words or not self.cuts:
            return [np.frombuffer(self.encode(t), "<u4") for t in said]
        whole = [self._stays_whole(t) for t in said]
        apart = iter(self._together(texts.filter(pa.array([not w for w in whole], pa.bool_())).fill_null("")))
        return [np.frombuffer(self.whole(t), "<u4") if w else next(apart) for t, w in zip(said, whole, strict=True)]

    def _together(self, texts: pa.Array) -> list[np.ndarray]:
        if not len(texts):
            return []
        texts = texts.cast(pa.large_string())
        ends = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
        if ends[0] == ends[-1]:
            return [np.empty(0, "<u4")] * len(texts)
        data = np.frombuffer(texts.buffers()[2], np.uint8)[ends[0] : ends[-1]]
        ends = ends - ends[0]
        kind = _KIND[data]
        letter = kind == _LETTER
        letter[1:] |= (data[:-1] == 0xC3) & (data[1:] != 0x97) & (data[1:] != 0xB7)  # from À to ÿ
        first = np.zeros(len(data), bool)
        first[1:] = (kind[1:] == _BLANK) & (kind[:-1] != _BLANK) | (kind[1:] == _MARK) & letter[:-1]
        first[ends[:-1][ends[:-1] < ends[1:]]] = True
        starts = np.flatnonzero(first)
        del kind, letter, first
        pieces = pa.Array.from_buffers(pa.large_string(), len(starts), [None, pa.py_buffer(np.append(starts, len(data))), pa.py_buffer(data)]).dictionary_encode()
        ids = pa.array(list(map(self.__getitem__, pieces.dictionary.to_numpy(zero_copy_only=False))), pa.large_binary()).take(pieces.indices)
        flat = np.frombuffer(ids.buffers()[2], "<u4")
        at = np.frombuffer(ids.buffers()[1], np.int64)[np.searchsorted(starts, ends)] // 4
        return [flat[a:b] for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]


_encoders: dict[str, Encoder] = {}


def encoder(path: str, memo: int = MEMO) -> Encoder:
    """This worker's encoder for a tokenizer file."""
    if path not in _encoders or _encoders[path].memo != memo:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        _encoders.clear()
        _encoders[path] = Encoder(path, memo)
    return _encoders[path]
