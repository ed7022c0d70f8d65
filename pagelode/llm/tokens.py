"""Token ids at corpus speed: each distinct word is encoded once per worker, texts are gathered from the words' ids."""

from __future__ import annotations

import json
import os

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from pagelode.llm.common import bounds, gather_ranges, row_sums, split_words

END_ID = 2
#: A word of these characters alone is cut by the vocabulary's pattern into at most a run of letters and a run of marks.
_PLAIN = "^[a-zß-öø-ÿ]+[!?.,;:*%#$&\"()]*$"
_MARKS = "!?.,;:*%#$&\"()"
_SAFE = "^[!-~À-ÖØ-öø-ÿ]+$"
#: Fixed value: the pattern by which the default vocabulary cuts.
_CUT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Pieces a worker remembers before it starts over; about 40 bytes each.
REMEMBERED = 1_000_000


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def drops_white_space(path: str) -> bool:
    """Whether a tokenizers file cuts texts so that no piece holds or looks across white space.

    Then a text's ids are its words' ids.  Known by the file itself: it normalizes
    character by character or makes one blank of white space, keeps nothing but the
    matches of the pattern that cuts at white space, and adds no token that takes
    blanks in.  Any other file is taken to depend on white space.
    """
    with open(path, encoding="utf-8") as f:
        file = json.load(f)
    steps = lambda part, key: [] if part is None else part[key] if part["type"] == "Sequence" else [part]
    normal = steps(file.get("normalizer"), "normalizers")
    plain = all(n["type"] in ("NFC", "Lowercase") or n == {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "} for n in normal)
    cuts = steps(file.get("pre_tokenizer"), "pretokenizers")
    cut = cuts[0] if cuts else {}
    at_space = cut.get("type") == "WhitespaceSplit" or (cut.get("type") == "Split" and cut.get("pattern") == {"Regex": _CUT} and cut.get("behavior") == "Removed" and cut.get("invert") is True)
    added = file.get("added_tokens") or []
    model = file.get("model", {})
    return plain and at_space and model.get("type") == "BPE" and not file.get("truncation") and not any(t["lstrip"] or t["rstrip"] or t["content"].split() != [t["content"]] for t in added)


class TextEncoder:
    """Encodes whole texts with any tokenizers file."""

    def __init__(self, path: str) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)

    def encode(self, texts: pa.Array, end: int | None = END_ID) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in order, each followed by ``end``, and where each text's begin and end.  Null is an empty text."""
        found = [e.ids if end is None else [*e.ids, end] for e in self.tokenizer.encode_batch_fast(texts.fill_null("").to_pylist(), add_special_tokens=False)]
        edges = bounds(np.fromiter(map(len, found), np.int64, len(found)))
        return np.fromiter((i for ids in found for i in ids), np.uint32, int(edges[-1])), edges


class WordEncoder:
    """Encodes texts with a tokenizers file that drops white space between words (see ``drops_white_space``).

    The tokenizer splits at white space before anything else crosses it, so a text's
    ids are its words' ids in order.  Distinct words are therefore encoded once and
    texts are gathered from them.  A lower-cased word of plain letters and trailing
    marks is made of two pieces, which are shared between words; every other word is
    given to the tokenizer as it stands.
    """

    def __init__(self, path: str) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self._forget()
        # For pieces of the two plain kinds, many at a time: they need no normalizing, and the id that ends a piece tells where the next begins.
        self.plain = Tokenizer.from_file(path)
        self.plain.normalizer = normalizers.Sequence([])
        self.plain.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.ends = np.zeros(max(vocabulary.values()) + 1, np.bool_)
        self.ends[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True

    def _forget(self) -> None:
        self.pieces = pa.array([], pa.string())
        self.flat = np.zeros(1 << 20, np.uint32)
        self.edges = np.zeros(1 << 17, np.int64)  # edges[k], edges[k + 1]: ids of piece k

    def _encode_new(self, pieces: list[str], plain: bool) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the pieces in order, and each one's number of ids."""
        if plain:
            joined = [" ".join(pieces[k : k + 512]) for k in range(0, len(pieces), 512)]
            ids = np.concatenate([np.array(e.ids, np.uint32) for e in self.plain.encode_batch_fast(joined, add_special_tokens=False)])
            last = np.flatnonzero(self.ends[ids])
            if len(last) == len(pieces):
                return ids, np.diff(last, prepend=-1)
        found = [e.ids for e in self.tokenizer.encode_batch_fast(pieces, add_special_tokens=False)]
        lengths = np.fromiter(map(len, found), np.int64, len(found))
        return np.fromiter((i for f in found for i in f), np.uint32, int(lengths.sum())), lengths

    def _places(self, pieces: pa.Array, plain: bool = True) -> np.ndarray:
        """The number of each piece, newly encoded where need be."""
        coded = pieces.dictionary_encode()
        place = pc.index_in(coded.dictionary, value_set=self.pieces)
        if place.null_count:
            new = coded.dictionary.filter(place.is_null())
            ids, lengths = self._encode_new(new.to_pylist(), plain)
            known = len(self.pieces)
            while known + len(new) + 1 > len(self.edges):
                self.edges = np.concatenate([self.edges, np.zeros_like(self.edges)])
            end = int(self.edges[known])
            while end + len(ids) > len(self.flat):
                self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
            self.flat[end : end + len(ids)] = ids
            self.edges[known + 1 : known + 1 + len(new)] = end + np.cumsum(lengths)
            self.pieces = pa.concat_arrays([self.pieces, new])
            numbers = place.fill_null(-1).to_numpy().astype(np.int64)
            numbers[numbers < 0] = known + np.arange(len(new))
        else:
            numbers = place.to_numpy().astype(np.int64)
        return numbers[coded.indices.to_numpy()]

    def encode(self, texts: pa.Array, end: int | None = END_ID) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in order, each followed by ``end``, and where each text's begin and end.  Null is an empty text."""
        if len(self.pieces) > REMEMBERED:
            self._forget()
        words, counts = split_words(texts)
        coded = words.dictionary_encode()
        distinct, index = coded.dictionary, coded.indices.to_numpy()
        lower = pc.utf8_lower(distinct)
        plain = pc.and_(pc.match_substring_regex(distinct, _SAFE), pc.match_substring_regex(lower, _PLAIN)).to_numpy(zero_copy_only=False)
        first = np.zeros(len(distinct), np.int64)
        second = np.full(len(distinct), -1, np.int64)
        if plain.any():
            kept = lower.filter(pa.array(plain))
            core = pc.utf8_rtrim(kept, characters=_MARKS)
            first[plain] = self._places(core)
            marked = pc.not_equal(core, kept).to_numpy(zero_copy_only=False)
            if marked.any():
                marks = pc.replace_substring_regex(kept.filter(pa.array(marked)), r"^[^!?.,;:*%#$&\"()]+", "")
                second[np.flatnonzero(plain)[marked]] = self._places(marks)
        if not plain.all():
            first[~plain] = self._places(distinct.filter(pa.array(~plain)), plain=False)
        a, la = self.edges[first], self.edges[first + 1] - self.edges[first]
        b, lb = self.edges[second], np.where(second < 0, 0, self.edges[second + 1] - self.edges[second])
        word_ids = gather_ranges(self.flat, np.stack([a, b], 1).ravel(), np.stack([la, lb], 1).ravel())
        ends = np.cumsum(la + lb)
        starts = ends - (la + lb)
        lengths = (la + lb)[index]
        ids = gather_ranges(word_ids, starts[index], lengths)
        edges = bounds(row_sums(lengths, bounds(counts)))
        if end is not None:
            ids = np.insert(ids, edges[1:], end)
            edges = edges + np.arange(len(edges))
        return ids.astype(np.uint32, copy=False), edges


_encoders: dict[str, TextEncoder | WordEncoder] = {}


def encoder(path: str) -> TextEncoder | WordEncoder:
    """This worker's encoder of a file, by words where the file allows it; workers outlive tasks, so what it learnt is used again."""
    if path not in _encoders:
        _encoders[path] = WordEncoder(path) if drops_white_space(path) else TextEncoder(path)
    return _encoders[path]


def id_type(path: str) -> np.dtype:
    """The smallest little-endian unsigned type that holds a vocabulary's ids."""
    size = encoder(path).tokenizer.get_vocab_size(with_added_tokens=True)
    return np.dtype("<u2" if size <= 1 << 16 else "<u4")
