"""Token ids of whole texts by a public tokenizer, with a bounded memory of chunks seen before.

A text is cut only where the tokenizer's own pre-tokenizer must cut, whatever stands on either side,
so the ids of the chunks in a row are the ids of the text.  A chunk not seen before is cut into the
pre-tokenizer's pieces, whose ids the tokenizer's model gives; one with rare characters or a special
token goes through the whole tokenizer.

Where any white space is a cut, the words of a batch and their pieces are cut, told apart and looked up in
arrays, without a Python object for a word; there only pieces and rare words are remembered.
"""

from __future__ import annotations

import os
import re
import zlib
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

# A byte-level tokenizer that keeps spaces starts a new piece at a space between two marks.
_CUT = re.compile(r"(?<=\S)(?= \S)")
# Printable Latin characters, and line ends between them: the classes of these are the same in any version of Unicode.
_SEEN = "!-~¡-¬®-ɏ"
_PLAIN = re.compile(rf" ?[{_SEEN}](?:[{_SEEN}\n]*[{_SEEN}])?")
_LATIN = 0x250
#: Pieces that the model takes at a time, since it needs some hundred bytes for each.
_AT_ONCE = 50_000
#: The pieces of the two pre-tokenizers, as their files and their library give them.
PIECES = {
    False: r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+",
    True: r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+",  # ``plain_words`` cuts by it
}


def byte_letters() -> dict[int, int]:
    """The letter that a byte-level model has for each byte: itself if it can be seen, else one from 256 on."""
    seen = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in seen]
    return {b: b for b in seen} | {b: 256 + k for k, b in enumerate(rest)}


class Table(dict):
    """Numbers of strings, and the ids of each number.  What is common comes early and stays; beyond ``most``
    a string is known until ``trim`` only."""

    def __init__(self, dtype: np.dtype, most: int):
        self.most, self.n, self.new, self.extra = most, 0, [], {}
        self.start, self.length, self.flat = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, dtype)

    def __missing__(self, key: str) -> int:
        if key in self.extra:
            return self.extra[key]
        (self if len(self) < self.most else self.extra)[key] = self.n
        self.new.append(key)
        self.n += 1
        return self.n - 1

    def numbers(self, keys, count: int) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, keys), np.int64, count)

    def add(self, lengths: np.ndarray, ids: np.ndarray, order: np.ndarray | None = None) -> None:
        """The ids of the new strings, in ``order``; a length of -1 says that a string has none of its own."""
        order = np.arange(len(lengths)) if order is None else order
        # Ids of strings that are not kept lie beyond those of the others, and are written over by later ones.
        used = int((self.start + np.maximum(self.length, 0)).max(initial=0))
        if used + len(ids) > len(self.flat):
            self.flat = np.concatenate([self.flat[:used], np.zeros(used + 2 * len(ids), self.flat.dtype)])
        self.flat[used : used + len(ids)] = ids
        n = np.maximum(lengths, 0)[order]
        start = np.empty(len(lengths), np.int64)
        start[order] = used + np.cumsum(n) - n
        self.start, self.length = np.concatenate([self.start, start]), np.concatenate([self.length, lengths])
        self.new = []

    def gather(self, at: np.ndarray) -> np.ndarray:
        """The ids of numbers, in a row."""
        n = np.maximum(self.length[at], 0)
        ends = np.cumsum(n)
        total = int(ends[-1]) if len(ends) else 0
        return self.flat[np.arange(total) + np.repeat(self.start[at] - (ends - n), n)]

    def trim(self) -> None:
        self.extra, self.n = {}, len(self)
        self.start, self.length = self.start[: self.n], self.length[: self.n]


def sums(n: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Sums of runs of ``n`` that have ``counts`` members."""
    total = np.concatenate([[0], np.cumsum(n)])
    ends = np.cumsum(counts)
    return total[ends] - total[ends - counts]


def runs(start: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Positions of runs that begin at ``start`` and have ``n`` members, in a row."""
    ends = np.cumsum(n)
    return np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(start - (ends - n), n)


def joined(strings: pa.Array, between: str) -> str:
    """All strings in one."""
    return pc.binary_join(pa.ListArray.from_arrays([0, len(strings)], strings), between)[0].as_py()


class PieceMemory:
    """Ids of pieces in arrays.  What is common comes early and stays; at most ``most`` pieces are kept."""

    def __init__(self, dtype: np.dtype, most: int):
        self.most, self.names = most, pa.array([], pa.string())
        self.length, self.flat = np.zeros(0, np.int64), np.zeros(0, dtype)

    def ids(self, names: pa.Array, learn) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start and length of the ids of distinct pieces, and those ids; ``learn`` gives unknown ones."""
        at = pc.index_in(names, value_set=self.names).fill_null(-1).to_numpy()
        new = names.filter(pa.array(at < 0))
        lengths, ids = learn(new) if len(new) else (np.zeros(0, np.int64), self.flat[:0])
        number = np.where(at < 0, len(self.names) + np.cumsum(at < 0) - 1, at)
        length, flat = np.concatenate([self.length, lengths]), np.concatenate([self.flat, ids])
        start = np.cumsum(length) - length
        kept = min(len(new), self.most - len(self.names))
        if kept:
            self.names = pa.concat_arrays([self.names, new[:kept]])
            self.length = length[: len(self.names)]
            self.flat = flat[: int(self.length.sum())].copy()
        return start[number], length[number], flat


class ChunkEncoder:
    """``drops_space``: the tokenizer discards white space, so any ASCII white space is a cut.

    Otherwise a key that starts with a space stands for what follows that space, and any other key
    for itself after a space; one that has white space at an end has no ids, its text being cut
    with care."""

    def __init__(self, path: str, drops_space: bool, most: int = 500_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import regex
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.drops_space = drops_space
        self.dtype = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        self.chunks, self.pieces = Table(self.dtype, most), Table(self.dtype, most)
        self.find = regex.compile(PIECES[drops_space] + r"|\t").findall
        self.special = re.compile("|".join(re.escape(t.content) for t in self.tokenizer.get_added_tokens_decoder().values()) or r"(?!)").search
        self.letters = byte_letters()
        # The same model on pieces that are cut already, with a mark of one id between them.
        self.model = Tokenizer(self.tokenizer.model)
        self.model.pre_tokenizer = pre_tokenizers.CharDelimiterSplit(" ")
        self.pieces["\t"] = 0  # between chunks; of no ids
        self.pieces.n = 1
        self.pieces.add(np.zeros(1, np.int64), np.zeros(0, self.dtype))
        self.mark = chr(self.letters[1])
        (self.mark_id,) = self.model.encode(self.mark).ids
        if drops_space:
            self.most, self.memory, self.rare = most, PieceMemory(self.dtype, most), {}
            vocab = self.tokenizer.get_vocab()
            # Ids that stand at the end of a piece only.
            self.ends = np.zeros(max(vocab.values()) + 1, bool)
            suffix = self.tokenizer.model.end_of_word_suffix
            self.ends[[k for t, k in vocab.items() if suffix and t.endswith(suffix)]] = True
            # Of each Latin character: 0 rare, 1 letter, 2 digit, 3 other; and its lower case, if that is one of them too.
            self.kind, self.lower = np.zeros(_LATIN, np.uint8), np.arange(_LATIN, dtype=np.uint32)
            for c in filter(re.compile(f"[{_SEEN}]").fullmatch, map(chr, range(_LATIN))):
                low = self.tokenizer.normalizer.normalize_str(c)
                if len(low) == 1 and ord(low) < _LATIN:
                    self.kind[ord(c)] = 1 if regex.match(r"\p{L}", low) else 2 if regex.match(r"\p{N}", low) else 3
                    self.lower[ord(c)] = ord(low)
            common = "".join(re.escape(chr(c)) for c in np.flatnonzero(self.kind).tolist())
            self.odd = "|".join([f"[^{common}]", *(re.escape(t.content) for t in self.tokenizer.get_added_tokens_decoder().values())])

    @staticmethod
    def careful(text: str) -> list[str]:
        """Keys of a text that the tokenizer need not cut at every space."""
        return [" " + c for c in _CUT.split(text)] if text else []

    def learn_pieces(self) -> None:
        """Ids of the pieces that are not known, which have no control characters."""
        self.pieces.add(*self.model_ids("\t".join(self.pieces.new)))

    def letters_of(self, pieces: str) -> str:
        """The model's letters of pieces with tabs between them, with spaces instead of these."""
        return pieces.encode().decode("latin-1").translate(self.letters | {9: 32})

    def model_ids(self, pieces: str) -> tuple[np.ndarray, np.ndarray]:
        """Number of ids of each piece, and the ids, of pieces with tabs between them."""
        ids = np.array(self.model.encode_batch_fast([self.letters_of(pieces).replace(" ", f" {self.mark} ")], add_special_tokens=False)[0].ids, self.dtype)
        marks = ids == self.mark_id
        at = np.concatenate([[-1], np.flatnonzero(marks), [len(ids)]])
        return np.diff(at) - 1, ids[~marks]

    def model_of(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """As ``model_ids``, for an array of pieces without white space; ids that can only end a piece need no marks."""
        lengths, out = [], []
        for k in range(0, len(pieces), _AT_ONCE):
            part = pieces[k : k + _AT_ONCE]
            text = joined(part, "\t")
            # Printable ASCII stands for itself.
            letters = text.replace("\t", " ") if text.isascii() else self.letters_of(text)
            ids = np.array(self.model.encode_batch_fast([letters], add_special_tokens=False)[0].ids, self.dtype)
            at = np.flatnonzero(self.ends[ids])
            if len(at) == len(part):
                n = np.diff(at, prepend=-1)
            else:
                n, ids = self.model_ids(text)
            lengths.append(n)
            out.append(ids)
        return np.concatenate(lengths), np.concatenate(out)

    def plain_words(self, words: pa.Array) -> tuple[np.ndarray, pa.Array]:
        """Of words of Latin characters: number of pieces of each, and the pieces in lower case."""
        if not len(words):
            return np.zeros(0, np.int64), pa.array([], pa.string())
        text = joined(words, "")
        points = self.lower[np.frombuffer(text.encode("utf-32-le"), "<u4")]
        size = pc.utf8_length(words).to_numpy().astype(np.int64)
        first = np.cumsum(size) - size
        kind = self.kind[points]
        # What lies beyond the last character begins anew.
        begins = np.zeros(len(points) + 4, bool)
        begins[first] = True
        begins[len(points) :] = True
        cut = begins.copy()
        cut[1 : len(points)] |= (kind[1:] != kind[:-1]) | (kind[1:] == 2)
        # 's, 't, 'm, 'd, 're, 've and 'll are pieces where a run of marks begins with them.
        for p in np.flatnonzero((points == 39) & cut[: len(points)] & ~begins[1 : len(points) + 1]).tolist():
            tail = "".join(map(chr, points[p + 1 : p + (2 if begins[p + 2] else 3)].tolist()))
            n = 2 if tail[:1] in ("s", "t", "m", "d") else 3 if tail in ("re", "ve", "ll") else 0
            if n:
                cut[p + 1], cut[p + n] = False, True
        at = np.flatnonzero(cut[: len(points)])
        # Characters below 128 take a byte, the others two.
        byte = np.arange(len(points) + 1) + np.concatenate([[0], np.cumsum(points > 127)])
        offsets = np.append(byte[at], byte[-1]).astype(np.int32)
        pieces = pa.StringArray.from_buffers(len(at), pa.py_buffer(offsets), pa.py_buffer(points.tobytes().decode("utf-32-le").encode()))
        return np.diff(np.searchsorted(at, np.append(first, len(points)))), pieces

    def words(self, names: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start and length of the ids of distinct words, and those ids."""
        odd = pc.match_substring_regex(names, self.odd).to_numpy(zero_copy_only=False)
        counts, pieces = self.plain_words(names.filter(pa.array(~odd)))
        coded = pieces.dictionary_encode()
        begin, n, flat = self.memory.ids(coded.dictionary, self.model_of)
        at = coded.indices.to_numpy()
        length = np.zeros(len(names), np.int64)
        length[~odd] = sums(n[at], counts)
        out = [flat[runs(begin[at], n[at])]]
        apart = names.filter(pa.array(odd)).to_pylist()
        for word in apart:
            ids = self.rare.get(word)
            if ids is None:
                ids = np.array(self.tokenizer.encode(word, add_special_tokens=False).ids, self.dtype).tobytes()
                if len(self.rare) < self.most:
                    self.rare[word] = ids
            out.append(np.frombuffer(ids, self.dtype))
        length[odd] = [len(x) for x in out[1:]]
        # Plain words lie before the others.
        start = np.zeros(len(names), np.int64)
        order = np.concatenate([np.flatnonzero(~odd), np.flatnonzero(odd)])
        start[order] = np.cumsum(length[order]) - length[order]
        return start, length, np.concatenate(out)

    def encode_words(self, lists: pa.ListArray) -> list[np.ndarray]:
        """Ids of texts cut into words."""
        coded = lists.flatten().dictionary_encode()
        start, length, flat = self.words(coded.dictionary.cast(pa.string()))
        at = coded.indices.to_numpy()
        n = length[at]
        return np.split(flat[runs(start[at], n)], np.cumsum(sums(n, np.diff(lists.offsets.to_numpy())))[:-1])

    def learn_chunks(self) -> None:
        """Ids of the keys that are not known."""
        new = self.chunks.new
        plain = list(map(_PLAIN.fullmatch, new))
        if self.special("\t".join(new)):
            plain = [m and not self.special(k) for k, m in zip(new, plain, strict=True)]
        # Keys that follow a space, keys that stand for themselves, and those that go through the whole tokenizer.
        first = [k[:1] == " " for k in new]
        kind = np.where(np.array([m is None or m is False for m in plain], bool), 2, np.array(first, bool).astype(np.int64))
        lengths = np.zeros(len(new), np.int64)
        found: list[str] = []
        spaced, own, odd = (np.flatnonzero(kind == k).tolist() for k in range(3))
        if spaced:
            found += self.find(" " + "\t ".join([new[k] for k in spaced]))
            found.append("\t")
        if own:
            found += self.find("\t".join([new[k][1:] for k in own]))
            found.append("\t")
        numbers = self.pieces.numbers(found, len(found))
        if self.pieces.new:
            self.learn_pieces()
        size = np.diff(np.concatenate([[0], np.cumsum(self.pieces.length[numbers])[numbers == 0]]))
        ids = [self.pieces.gather(numbers)]
        self.pieces.trim()
        for k in odd:
            key = new[k]
            if not key or key[0] != " " and (key[0].isspace() or key[-1].isspace()):
                lengths[k] = -1
                continue
            text = key[1:] if key[0] == " " else " " + key
            ids.append(np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, self.dtype))
            lengths[k] = len(ids[-1])
        at = np.array(spaced + own, np.int64)
        lengths[at] = size
        self.chunks.add(lengths, np.concatenate(ids), np.concatenate([at, np.array(odd, np.int64)]))

    def encode_keys(self, cut: list[list[str]]) -> list[np.ndarray]:
        """Ids of texts cut into keys that have ids."""
        counts = np.array([len(k) for k in cut], np.int64)
        numbers = self.chunks.numbers(chain.from_iterable(cut), int(counts.sum()))
        if self.chunks.new:
            self.learn_chunks()
        return np.split(self.chunks.gather(numbers), np.cumsum(sums(self.chunks.length[numbers], counts))[:-1])

    def encode(self, texts: list[str | None] | pa.Array) -> list[np.ndarray]:
        """Ids of each text, without special tokens; null is an empty text."""
        column = texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string())
        if not len(column):
            return []
        column = column.fill_null("")
        if self.drops_space:
            out = self.encode_words(pc.ascii_split_whitespace(column))
            odd = pc.or_(pc.match_substring(column, "\x0b"), pc.match_substring(column, "\x0c"))
            apart = np.flatnonzero(odd.to_numpy(zero_copy_only=False)).tolist()
            cut = pa.array([re.split(r"[ \t\n\r]+", column[i].as_py()) for i in apart], pa.list_(pa.string()))
            for i, ids in zip(apart, self.encode_words(cut) if apart else [], strict=True):
                out[i] = ids
            return out
        lists = pc.split_pattern(column, " ")
        coded = lists.flatten().dictionary_encode()
        names, at = coded.dictionary.to_pylist(), coded.indices.to_numpy()
        counts = np.diff(lists.offsets.to_numpy())
        numbers = self.chunks.numbers(names, len(names))[at]
        apart: dict[int, list[str]] = {}
        # The first word of a text has no space before it.
        begin = np.cumsum(counts) - counts
        for i, (k, n) in enumerate(zip(begin.tolist(), counts.tolist(), strict=True)):
            word = names[at[k]]
            if not word or n > 1 and word[-1].isspace():
                apart[i] = self.careful(column[i].as_py())
            else:
                numbers[k] = self.chunks[" " + word]
        if self.chunks.new:
            self.learn_chunks()
        length = self.chunks.length[numbers]
        for i in np.flatnonzero(sums(length < 0, counts)).tolist():
            if i not in apart:
                apart[i] = self.careful(column[i].as_py())
        out = np.split(self.chunks.gather(numbers), np.cumsum(sums(np.maximum(length, 0), counts))[:-1])
        if apart:
            for i, ids in zip(apart, self.encode_keys(list(apart.values())), strict=True):
                out[i] = ids
        self.chunks.trim()
        return out


_ENCODERS: dict[tuple, ChunkEncoder] = {}


def encoder(path: str, drops_space: bool, most: int = 500_000) -> ChunkEncoder:
    """One encoder per worker process, the last that was asked for."""
    key = (path, drops_space, most)
    if key not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[key] = ChunkEncoder(path, drops_space, most)
    return _ENCODERS[key]


def forget() -> None:
    """Free the encoder of this worker process."""
    _ENCODERS.clear()


def crc_of(ids: np.ndarray) -> int:
    return zlib.crc32(ids.astype("<u4").tobytes())


def public_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)
