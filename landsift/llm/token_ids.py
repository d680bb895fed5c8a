"""Token ids of many texts, word by word.

Texts share most of their words, and both tokenizers cut texts at white space before they
merge. So the words of a batch are made distinct by Arrow, new ones are encoded by the
tokenizers library, and the ids of whole texts are put together by offsets. Texts for which
the cut at blanks might not hold (runs of blanks, other white space, special tokens) are
encoded whole.
"""

from __future__ import annotations

import json
import os
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex

#: Words whose ids a worker keeps; when there are more, it starts anew.
KEPT_WORDS = 600_000
#: Characters of texts that are worked on at a time; a longer text is on its own.
BATCH_CHARACTERS = 2_000_000
#: White space other than space and line feed, characters that some versions of Unicode
#: count as such, the start mark below, and special tokens.
_ODD = (
    "[\\x00\\t\\x0b\\x0c\\r\\x1c-\\x1f\\x{85}\\x{a0}\\x{1680}\\x{180e}\\x{2000}-\\x{200f}\\x{2028}-\\x{202f}"
    "\\x{205f}-\\x{206f}\\x{3000}\\x{feff}]|[ \\n][ \\n]|\\A[ \\n]|[ \\n]\\z|<\\|"
)
#: The pattern of byte-level tokenizers that name none (fixed value).
_BYTE_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_START = "\x00"


def _byte_letters() -> dict[int, str]:
    """Byte-level letters: printable bytes stand for themselves, others for U+0100 and on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(rest)}


class TokenIds:
    """Ids of texts by one tokenizer file, without special tokens of its own.

    ``lower``: the file folds case and drops white space (words end in a mark); otherwise a
    word is encoded with the blank before it.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_file(path)
        said = json.loads(self.tokenizer.to_str())
        self.lower = said["normalizer"] is not None
        steps = said["pre_tokenizer"].get("pretokenizers", [])
        self._pattern = regex.compile(steps[0]["pattern"]["Regex"] if steps else _BYTE_PATTERN)
        self._model = self.tokenizer.model
        self._letters = _byte_letters()
        self._known: dict[str, bytes] = {}
        self._pieces: dict[str, bytes] = {}

    def whole(self, text: str) -> np.ndarray:
        """Ids of a text by the library alone."""
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype=np.uint32)

    def _word(self, word: str) -> bytes:
        if not self.lower:
            word = word[1:] if word[0] == _START else word if word[0] == "\n" else " " + word
        plain = word.isascii()
        if not plain and max(word) > "ɏ":  # versions of Unicode may differ there
            return self.whole(word).tobytes()
        known, found = self._pieces, []
        for piece in self._pattern.findall(word.lower() if self.lower else word):
            ids = known.get(piece)
            if ids is None:
                letters = self._letters
                mapped = piece if plain and self.lower else "".join([letters[b] for b in piece.encode()])
                ids = known[piece] = array("I", [t.id for t in self._model.tokenize(mapped)]).tobytes()
            found.append(ids)
        return found[0] if len(found) == 1 else b"".join(found)

    def _plain(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        if self.lower:
            split = pc.split_pattern(pc.replace_substring(texts, "\n", " "), " ")
        else:
            marked = pc.binary_join_element_wise(pa.scalar(_START, texts.type), texts, pa.scalar("", texts.type))
            split = pc.split_pattern(pc.replace_substring(marked, "\n", " \n"), " ")
        counts = np.diff(split.offsets.to_numpy())
        coded = split.flatten().dictionary_encode()
        if len(self._known) > KEPT_WORDS:
            self._known.clear()
            self._pieces.clear()
        known, found = self._known, []
        for word in coded.dictionary.to_numpy(zero_copy_only=False):
            ids = known.get(word)
            if ids is None:
                ids = known[word] = self._word(word) if word else b""
            found.append(ids)
        flat = np.frombuffer(b"".join(found), dtype=np.uint32)
        lengths = np.fromiter(map(len, found), dtype=np.int64, count=len(found)) // 4
        starts = np.cumsum(lengths) - lengths
        at = coded.indices.to_numpy()
        n = lengths[at]
        ends = np.cumsum(n)
        places = np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts[at] - (ends - n), n)
        texts_end = np.concatenate([[0], ends])[np.cumsum(counts)]
        return flat[places], np.diff(texts_end, prepend=0)

    def ids(self, texts: pa.Array, end: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts one after the other, and how many each has. Null is empty.

        ``end`` is put after every text.
        """
        texts = pc.fill_null(pa.array(texts, pa.string()) if not isinstance(texts, pa.Array) else texts, "")
        odd = pc.match_substring_regex(texts, _ODD).to_numpy(zero_copy_only=False)
        odd |= pc.equal(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
        flat, lengths = self._plain(texts.filter(pa.array(~odd))) if not odd.all() else (np.zeros(0, np.uint32), np.zeros(0, np.int64))
        if not odd.any() and end is None:
            return flat, lengths
        own = [self.whole(t) for t in texts.filter(pa.array(odd)).to_pylist()]
        cut = np.concatenate([[0], np.cumsum(lengths)])
        parts, sizes, k, j = [], np.zeros(len(texts), np.int64), 0, 0
        tail = np.array([] if end is None else [end], dtype=np.uint32)
        for i, special in enumerate(odd.tolist()):
            if special:
                part, j = own[j], j + 1
            else:
                part, k = flat[cut[k] : cut[k + 1]], k + 1
            parts += [part, tail]
            sizes[i] = len(part) + len(tail)
        return np.concatenate(parts) if parts else np.zeros(0, np.uint32), sizes


_LOADED: dict[str, TokenIds] = {}


def tokenizer(path: str) -> TokenIds:
    """The tokenizer of a file, once per worker."""
    if path not in _LOADED:
        _LOADED[path] = TokenIds(path)
    return _LOADED[path]


def slices(batch: pa.RecordBatch, column: str, characters: int = BATCH_CHARACTERS):
    """A batch in slices of rows whose texts have about so many bytes."""
    sizes = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    start = 0
    while start < batch.num_rows:
        before = sizes[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(sizes, before + characters, side="right")))
        yield batch.slice(start, stop - start)
        start = stop
