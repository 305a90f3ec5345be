"""Encoding of whole texts with the ``tokenizers`` library inside Spark tasks."""

from __future__ import annotations

import json
import os

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Appended to each document.
END_ID = 2
#: No text piece between white space holds this; it parts pieces that are encoded together.
_MARK = "\x01"


#: The steps before the model for which the ids of a text are those of its pieces between white space.
_NORMALIZERS = ["NFC", "Replace", "Lowercase"]
_SPLIT = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"


def parts_at_white_space(spec: dict) -> bool:
    """Whether a tokenizer file drops white space, parts letters from signs and adds nothing, so that pieces can be encoded one by one."""
    steps = (spec.get("normalizer") or {}).get("normalizers") or []
    before = (spec.get("pre_tokenizer") or {}).get("pretokenizers") or []
    return (
        [x["type"] for x in steps] == _NORMALIZERS
        and (steps[1]["pattern"], steps[1]["content"]) == ({"Regex": "\\s+"}, " ")
        and [x["type"] for x in before] == ["Split", "ByteLevel"]
        and (before[0]["pattern"], before[0]["behavior"], before[0]["invert"]) == ({"Regex": _SPLIT}, "Removed", True)
        and not (before[1]["add_prefix_space"] or before[1]["use_regex"] or spec.get("truncation") or spec.get("padding"))
        and not any(t["normalized"] or t["lstrip"] or t["rstrip"] or t["single_word"] for t in spec.get("added_tokens") or [])
    )


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class WordEncoder:
    """Ids of whole texts, equal to ``Tokenizer.encode(text, add_special_tokens=False)``.

    A tokenizer that drops white space and never merges across it or between a letter and a
    punctuation mark (``parts_at_white_space``) gives a text the ids of its pieces one after the other.
    Each distinct piece is encoded once by the library and remembered, up to ``most`` pieces. Texts
    with the string of an added token, and all texts of other tokenizers, are encoded whole.
    """

    _own: dict[str, WordEncoder] = {}

    def __init__(self, path: str, most: int = 1_500_000):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        spec = json.loads(self.tok.to_str())
        self.by_piece, self.added = parts_at_white_space(spec), [t["content"] for t in spec.get("added_tokens") or []]
        self.most = most
        self._forget()
        if self.by_piece:
            (self.mark,) = self.tok.encode(_MARK, add_special_tokens=False).ids

    def _forget(self) -> None:
        self.known, self.flat = pa.array([], pa.string()), np.zeros(0, np.uint32)
        self.first, self.size = np.zeros(0, np.int64), np.zeros(0, np.int64)

    @classmethod
    def of(cls, path: str) -> WordEncoder:
        """One encoder for each worker process and file."""
        if path not in cls._own:
            cls._own[path] = cls(path)
        return cls._own[path]

    def _ids_of(self, pieces: list[str], at_once: int = 256) -> list[np.ndarray]:
        """The library's ids of each piece; pieces are handed over in groups, parted by a mark."""
        groups = [pieces[i : i + at_once] for i in range(0, len(pieces), at_once)]
        out = []
        for group, e in zip(groups, self.tok.encode_batch_fast([f" {_MARK} ".join(g) for g in groups], add_special_tokens=False), strict=True):
            ids = np.array(e.ids, np.uint32)
            marks = np.flatnonzero(ids == self.mark)
            if len(marks) == len(group) - 1:
                cuts = [0, *(marks + 1).tolist(), len(ids) + 1]
                out += [ids[a : b - 1] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
            else:  # a piece holds the mark itself
                out += [np.array(self.tok.encode(p, add_special_tokens=False).ids, np.uint32) for p in group]
        return out

    def _learn(self, pieces: pa.Array) -> None:
        new = self._ids_of(pieces.to_pylist())
        size = np.fromiter(map(len, new), np.int64, len(new))
        self.first = np.concatenate([self.first, len(self.flat) + np.cumsum(size) - size])
        self.size = np.concatenate([self.size, size])
        self.flat = np.concatenate([self.flat, *new])
        self.known = pa.concat_arrays([self.known, pieces])

    @staticmethod
    def _joined(parts: list[np.ndarray], end: int | None) -> tuple[np.ndarray, np.ndarray]:
        last = [] if end is None else [np.array([end], np.uint32)]
        flat = [x for p in parts for x in (p, *last)]
        return np.concatenate(flat) if flat else np.zeros(0, np.uint32), np.fromiter((len(p) + len(last) for p in parts), np.int64, len(parts))

    def encode(self, texts: pa.Array, end: int | None = END_ID) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, one after the other; number of ids of each text). Null is empty."""
        texts = pc.fill_null(texts, "")
        if not self.by_piece:
            return self._joined([np.array(e.ids, np.uint32) for e in self.tok.encode_batch_fast(texts.to_pylist(), add_special_tokens=False)], end)
        whole = np.zeros(len(texts), bool)
        for string in self.added:
            whole |= pc.match_substring(texts, string).to_numpy(zero_copy_only=False)
        if whole.any():
            ids, counts = self.encode(pc.if_else(pa.array(whole), "", texts), None)
            parts = np.split(ids, np.cumsum(counts)[:-1])
            for k in np.flatnonzero(whole).tolist():
                parts[k] = np.array(self.tok.encode(texts[k].as_py(), add_special_tokens=False).ids, np.uint32)
            return self._joined(parts, end)
        texts = pc.replace_substring_regex(texts, r"(\pL)([.,;:!?])", r"\1 \2")
        # In a text of ASCII only, lower case is what the tokenizer's own normaliser gives.
        texts = pc.if_else(pc.string_is_ascii(texts), pc.ascii_lower(texts), texts)
        lists = pc.ascii_split_whitespace(texts)
        coded = lists.flatten().dictionary_encode()
        if len(self.known) > self.most:
            self._forget()
        place = pc.index_in(coded.dictionary, value_set=self.known)
        if place.null_count:
            self._learn(coded.dictionary.filter(pc.is_null(place)))
            place = pc.index_in(coded.dictionary, value_set=self.known)
        which = place.to_numpy()[coded.indices.to_numpy()]
        n = self.size[which]
        upto = np.concatenate([[0], np.cumsum(n)])
        bounds = upto[lists.offsets.to_numpy()]  # ids before each text
        counts = np.diff(bounds)
        source = np.repeat(self.first[which] - upto[:-1], n) + np.arange(upto[-1])
        ids = self.flat[source]
        if end is not None:
            ids = np.insert(ids, bounds[1:], np.uint32(end))
            counts = counts + 1
        return ids, counts
