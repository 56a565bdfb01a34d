"""Whole-text token ids of a public word tokenizer, with an exact cache of words.

The tokenizer splits a text into words, digits and runs of signs, and codes each by itself. So all texts of
a call are split at once, in arrays of their bytes, and each distinct part is coded once, by the library;
parts are looked up by their bytes. Texts with characters beyond Latin letters, with unusual white space or
with a special token's opening go to the library whole: there its tables of Unicode decide.
"""

from __future__ import annotations

import os
import re
import unicodedata
from itertools import repeat

import numpy as np
import pyarrow as pa

from stratolog.llm.shared import kept

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

#: Cached words at most; a full cache starts anew.
HELD = 1_000_000
_LATIN = [chr(c) for c in range(0x250)]
_BLANK = b"\t\n\r "
#: Of ASCII, all that isn't odd.
_PLAIN = _BLANK + bytes(range(0x21, 0x7F))
#: Letters whose small forms lie beyond, as that of Ɓ, go to the library too.
_ODD = re.compile("[^" + "".join(c for c in _LATIN[0xA1:] if len(c.lower()) == 1 and c.lower() in _LATIN) + "]")
_SPACE, _LETTER, _NUMBER, _SIGN = range(4)
#: The kind of each character below U+0250; white space is what texts with no odd character hold.
_KINDS = np.array([_SPACE if c in "\t\n\r " else {"L": _LETTER, "N": _NUMBER}.get(unicodedata.category(c)[0], _SIGN) for c in _LATIN], np.uint8)
_OF_BYTE = _KINDS[:0x100].tobytes()
#: The byte-level character of each byte that is not itself one: the space stays, as it lies between parts.
_KEPT = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
_BYTES = {b: 0x100 + k for k, b in enumerate(b for b in range(0x100) if b not in _KEPT) if b != 0x20}


def is_odd(text: str) -> bool:
    return "<|" in text or _ODD.search(text.encode().translate(None, _PLAIN).decode()) is not None


def split_parts(texts: list[bytes]) -> tuple[pa.Array, np.ndarray]:
    """The parts of lower-case texts without odd characters, and where each text's parts begin and the last one's end.

    Parts are what the tokenizer's pattern finds: 's|'t|'re|'ve|'m|'ll|'d, runs of letters, single numbers and
    runs of signs.
    """
    # two bytes more, so that looking ahead needs no bounds
    joined = b"\n".join([*texts, b"", b""])
    text, kind = np.frombuffer(joined, np.uint8), np.frombuffer(joined.translate(_OF_BYTE), np.uint8)
    lead = np.zeros(0, np.int64) if joined.isascii() else np.flatnonzero(text >= 0xC0)
    if len(lead):
        kind = kind.copy()
        kind[lead] = kind[lead + 1] = _KINDS[(text[lead] & 0x1F).astype(np.int64) << 6 | text[lead + 1] & 0x3F]
    full = kind != _SPACE
    first = full.copy()
    first[1:] &= (kind[1:] != kind[:-1]) | (kind[1:] == _NUMBER)
    first[lead + 1] = False
    # an apostrophe within signs belongs to them
    at = np.flatnonzero(first & (text == ord("'")))
    one, two = text[at + 1], text[at + 2]
    short = np.isin(one, np.frombuffer(b"stmd", np.uint8))
    long = ((one == ord("l")) & (two == ord("l"))) | ((two == ord("e")) & ((one == ord("r")) | (one == ord("v"))))
    at, n = at[short | long], np.where(short, 2, 3)[short | long]
    first[at + 1] = False
    first[at + n] = full[at + n]
    # a part's last byte comes before the next part or white space, of which the text's end has some
    last = full[:-1] & (first[1:] | ~full[1:])
    begin = np.flatnonzero(first)
    offsets = np.append(0, np.cumsum(np.flatnonzero(last) + 1 - begin)).astype(np.int32)
    parts = pa.Array.from_buffers(pa.binary(), len(begin), [None, pa.py_buffer(offsets), pa.py_buffer(joined.translate(None, _BLANK))])
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    return parts, np.searchsorted(begin, np.append(0, np.cumsum(sizes + 1)))


class WordTokenizer:
    def __init__(self, path: str, held: int = HELD):
        from tokenizers import Tokenizer, pre_tokenizers

        self.library, self.held = Tokenizer.from_file(path), held
        # the same model for parts, which need no normalizer and no pattern and come with their bytes as its characters
        self.coder = Tokenizer(self.library.model)
        self.coder.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        vocab = self.library.get_vocab()
        self.ends = np.zeros(max(vocab.values()) + 1, bool)
        self.ends[[i for p, i in vocab.items() if p.endswith("</w>")]] = True
        self._reset()

    def _reset(self) -> None:
        self.index: dict[bytes, int] = {}
        self.flat, self.offset, self.size = np.zeros(0, np.uint32), np.zeros(0, np.int32), np.zeros(0, np.int32)

    def _code(self, lines: list[bytes]) -> list[np.ndarray]:
        """The ids of lines of parts with spaces between them."""
        return [np.array(e.ids, np.uint32) for e in self.coder.encode_batch_fast([x.decode("latin-1").translate(_BYTES) for x in lines], add_special_tokens=False)]

    def _learn(self, words: list[bytes]) -> None:
        flat, sizes = [self.flat], [self.size]
        for lo in range(0, len(words), 20_000):
            part = words[lo : lo + 20_000]
            got = self._code([b" ".join(part[k : k + 100]) for k in range(0, len(part), 100)])
            ids = np.concatenate(got)
            last = np.flatnonzero(self.ends[ids])
            if len(last) != len(part):  # a word that codes otherwise beside others
                got = self._code(part)
                ids, size = np.concatenate(got), np.array([len(x) for x in got])
            else:
                size = np.diff(last, prepend=-1)
            flat.append(ids)
            sizes.append(size.astype(np.int32))
        self.index.update(zip(words, range(len(self.index), len(self.index) + len(words))))
        self.flat, self.size = np.concatenate(flat), np.concatenate(sizes)
        self.offset = np.cumsum(self.size, dtype=np.int32) - self.size

    def _look_up(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.index.get, words, repeat(-1)), np.int64, len(words))

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, ids of each): as the library codes each text, without special tokens."""
        whole = {k: np.array(self.library.encode(t, add_special_tokens=False).ids, np.uint32) for k, t in enumerate(texts) if is_odd(t)}
        parts, cuts = split_parts([b"" if k in whole else t.lower().encode() for k, t in enumerate(texts)])
        coded = parts.dictionary_encode()
        words = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        at = self._look_up(words)
        missing = np.flatnonzero(at < 0).tolist()
        if missing:
            new = [words[k] for k in missing]
            if len(new) + len(self.index) > self.held:
                self._reset()
                new = words
            self._learn(new)
            at = self._look_up(words)
        at = at[coded.indices.to_numpy()]
        size = self.size[at]
        ends = np.append(0, np.cumsum(size, dtype=np.int64))
        ids = self.flat[np.repeat(self.offset[at] - ends[:-1], size) + np.arange(ends[-1])]
        cuts = ends[cuts]
        counts = np.diff(cuts)
        if whole:
            counts[list(whole)] = [len(x) for x in whole.values()]
            ids = np.concatenate([whole[k] if k in whole else ids[cuts[k] : cuts[k + 1]] for k in range(len(texts))])
        return ids, counts


#: The step for which a worker keeps its tokenizer.
CODING = "coding"


def tokenizer(path: str) -> WordTokenizer:
    """The worker process's tokenizer, whose cache lasts from task to task of the step CODING."""
    return kept(CODING, path, lambda: WordTokenizer(path))
