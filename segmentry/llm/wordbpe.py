"""Token ids of whole texts from a BPE file of the tokenizers library, each distinct word encoded once per worker.

Where a file's tokenizer splits at white space before anything else can join two words, a text's ids are
those of its pieces between ASCII white space, one after the other. Pieces met before come from a
cache of bounded size. A new piece of printable characters below U+0300 is split by the file's own pattern into
words for the library's BPE model; any other goes through the library's whole encoder. A file whose normaliser, splitter
or model is another is used as it is, on whole texts.
"""

from __future__ import annotations

import json
import struct

import numpy as np

#: The tokenizer file's pre-tokenizer pattern (a fixed value of its format).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Entries of a generation of either cache, and the bytes of the longest piece that is kept. When the young one is full it becomes the old one, and what is met again moves back.
CACHE, LONGEST = 100_000, 40


def vocabulary(name: str) -> str:
    """The local path of a file of the installed tokenizers; resolved on the worker that reads it."""
    import public_tokenizers

    return public_tokenizers.path(name)


class WordEncoder:
    def __init__(self, file: str = "word_bpe_49k.json"):
        import regex
        from tokenizers import Tokenizer

        path = vocabulary(file)
        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as spec:
            self.by_words = splits_at_blanks(json.load(spec))
        self.split = regex.compile(PATTERN).findall
        self.plain = regex.compile(r"[\x21-\x7e\xa1-\xac\xae-˿]+").fullmatch
        self.model = self.tokenizer.model
        self.pieces: dict[bytes, bytes] = {}
        self.words: dict[bytes, bytes] = {}
        self.old_pieces, self.old_words = self.pieces, self.words
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = [b for b in range(256) if b not in set(printable)]
        #: The byte-level alphabet: printable bytes stand for themselves, the others follow from U+0100.
        self.alphabet = {b: b for b in printable} | {b: 256 + i for i, b in enumerate(rest)}

    def _word(self, word: bytes) -> bytes:
        ids = self.words.get(word)
        if ids is None:
            ids = self.old_words.get(word)
            if ids is None:
                spelled = word.decode() if word.isascii() else word.decode("latin-1").translate(self.alphabet)
                ids = packed([t.id for t in self.model.tokenize(spelled)])
            if len(word) <= LONGEST:
                self.words[word] = ids
        return ids

    def _piece(self, piece: bytes) -> bytes:
        core = piece.rstrip(b".,")
        if core.isalpha():  # of bytes: A-Z and a-z only
            ids = self._word(core.lower())
            return ids + self._word(piece[len(core) :]) if len(core) < len(piece) else ids
        text = piece.decode()
        core = text.rstrip(".,")
        word = core.lower()
        if word.isalpha() and max(word) < "\u0300":
            ids = self._word(word.encode())
            return ids + self._word(text[len(core) :].encode()) if len(core) < len(text) else ids
        if self.plain(text) and not any(s in text for s in self.special):
            return b"".join([self._word(w.encode()) for w in self.split(text.lower())])
        return packed(self.tokenizer.encode(text, add_special_tokens=False).ids)

    def encode(self, text: bytes) -> np.ndarray:
        """The ids of a UTF-8 text as unsigned 32-bit integers."""
        if not self.by_words:
            return np.array(self.tokenizer.encode(text.decode(), add_special_tokens=False).ids, "<u4")
        if len(self.pieces) >= CACHE:
            self.old_pieces, self.pieces = self.pieces, {}
        if len(self.words) >= CACHE:
            self.old_words, self.words = self.words, {}
        pieces, known, old = text.split(), self.pieces, self.old_pieces
        long: dict[bytes, bytes] = {}
        for piece in set(pieces).difference(known):
            if len(piece) <= LONGEST:
                known[piece] = old.get(piece) or self._piece(piece)
            else:
                long[piece] = self._piece(piece)
        found = map(known.__getitem__, pieces) if not long else (long[p] if p in long else known[p] for p in pieces)
        return np.frombuffer(b"".join(found), "<u4")


def splits_at_blanks(spec: dict) -> bool:
    """Whether a tokenizer file is of the kind that the word encoder reads: lower case, white space split off and dropped, words with an end mark."""
    normal, before, model = spec.get("normalizer") or {}, spec.get("pre_tokenizer") or {}, spec.get("model") or {}
    steps = [x["type"] for x in normal.get("normalizers", [])], [x["type"] for x in before.get("pretokenizers", [])]
    if steps != (["NFC", "Replace", "Lowercase"], ["Split", "ByteLevel"]) or spec.get("added_tokens") is None:
        return False
    blanks, (split, _) = normal["normalizers"][1], before["pretokenizers"]
    return (
        blanks.get("pattern") == {"Regex": "\\s+"} and blanks.get("content") == " " and split.get("pattern") == {"Regex": PATTERN} and split.get("behavior") == "Removed" and split.get("invert") is True
        and model.get("type") == "BPE" and model.get("end_of_word_suffix") == "</w>" and not model.get("dropout")
    )


def packed(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


_encoders: dict[str, WordEncoder] = {}


def encoder(file: str) -> WordEncoder:
    """One encoder a worker process and file."""
    if file not in _encoders:
        _encoders[file] = WordEncoder(file)
    return _encoders[file]
