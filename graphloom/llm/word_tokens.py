"""Token ids of many texts at once, for a tokenizer whose pre-tokenizer never joins text across white space.

A batch's texts are lower-cased, parted from the marks after their words, split at ASCII white space and dictionary-encoded
in Arrow, so that Python sees each distinct chunk of a batch once. What the texts hold is then gathered by offsets. Chunks
that a batch has several times are remembered from batch to batch of a task, at most ``MOST_CACHED``.

Defined cases: a null text is empty and has no ids; an empty batch gives no ids; special tokens' strings are ordinary text;
texts may repeat and be of any length that an Arrow array of strings holds.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Chunks that are remembered: some 30 MB.
MOST_CACHED = 150_000
#: Words that go to the tokenizer as one text; longer texts cost it more a word.
TOGETHER = 100
#: Words whose ids are gathered at a time.
AT_ONCE = 1 << 18
#: Texts with characters that the two sides may lower-case or split differently; they are left as they are.
ODD = r"[^\x00-\x{24F}]|[\x{85}\x{A0}\x{130}]"
#: A mark after a word is a word of its own.
MARK = r"(\p{L})([.,!?;:])(\s|$)"


class WordTokenizer:
    """Token ids as by ``tokenizers`` for a file of the word kind, without special tokens.

    Its words end at white space, so each distinct chunk between white space is tokenized once and then looked up. New
    chunks go to the tokenizer together. Lower-case words need none of its normalizing and splitting, and each ends in a
    piece of its own kind; others are told apart by where their pieces start.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        self.full = Tokenizer.from_file(path)
        self.plain = Tokenizer(self.full.model)  # one vocabulary for both
        self.full.encode_special_tokens = self.plain.encode_special_tokens = True
        self.plain.normalizer = normalizers.Sequence([])
        self.plain.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        vocabulary = self.full.get_vocab(with_added_tokens=True)
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for piece, i in vocabulary.items() if piece.endswith("</w>")]] = True
        self.cache: dict[str, bytes] = {}

    def _words(self, words: list[str]) -> list[bytes]:
        out = []
        for at in range(0, len(words), TOGETHER):
            ids = np.array(self.plain.encode(" ".join(words[at : at + TOGETHER]), add_special_tokens=False).ids, "<u4")
            raw, cuts = ids.tobytes(), ((np.flatnonzero(self.ends[ids]) + 1) * 4).tolist()
            out += [raw[low:high] for low, high in zip([0, *cuts], cuts)]
        return out

    def _others(self, chunks: list[str]) -> list[bytes]:
        out = []
        for at in range(0, len(chunks), TOGETHER):
            part = chunks[at : at + TOGETHER]
            found = self.full.encode(" ".join(part), add_special_tokens=False)
            raw, starts = np.array(found.ids, "<u4").tobytes(), np.array([a for a, _ in found.offsets], np.int64)
            cuts = (np.searchsorted(starts, np.cumsum([0] + [len(chunk) + 1 for chunk in part])) * 4).tolist()
            out += [raw[low:high] for low, high in zip(cuts, cuts[1:])]
        return out

    def ids_of(self, chunks: list[str], often: np.ndarray) -> list[bytes]:
        """The packed ids of distinct chunks; those that come ``often`` are remembered."""
        found = list(map(self.cache.get, chunks))
        new = [i for i, got in enumerate(found) if got is None]
        is_word = [(c := chunks[i]).islower() and c.isalpha() and (c.isascii() or max(c) < "\u0250") for i in new]
        for way, wanted in ((self._words, True), (self._others, False)):
            at = [i for i, word in zip(new, is_word) if word is wanted]
            for i, ids in zip(at, way([chunks[i] for i in at])):
                found[i] = ids
        self.cache.update((chunks[i], found[i]) for i in new if often[i])
        if len(self.cache) > MOST_CACHED:  # frequent chunks come early: the newest half goes
            for old in list(self.cache)[MOST_CACHED // 2 :]:
                del self.cache[old]
        return found

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, where each text's begin): text ``i`` has ``ids[begins[i] : begins[i + 1]]``."""
        texts = pc.fill_null(texts, "")
        parted = pc.replace_substring_regex(pc.utf8_lower(texts), MARK, r"\1 \2\3")
        lists = pc.ascii_split_whitespace(pc.if_else(pc.match_substring_regex(texts, ODD), texts, parted))
        coded = lists.flatten().dictionary_encode()
        which = coded.indices.to_numpy()
        chunks = coded.dictionary.to_pylist()
        packed = self.ids_of(chunks, np.bincount(which, minlength=len(chunks)) > 1)
        sizes = np.fromiter(map(len, packed), np.int32, len(packed)) // 4
        bank, firsts = np.frombuffer(b"".join(packed), "<u4"), np.cumsum(sizes, dtype=np.int32) - sizes
        ids, ends = [np.empty(0, "<u4")], [np.zeros(1, np.int64)]
        for at in range(0, len(which), AT_ONCE):
            part = which[at : at + AT_ONCE]
            each = sizes[part]
            after = np.cumsum(each, dtype=np.int32)
            ids.append(bank[np.repeat(firsts[part] - (after - each), each) + np.arange(after[-1], dtype=np.int32)])
            ends.append(ends[-1][-1] + after)
        words = np.concatenate(([0], np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False), dtype=np.int64)))
        return np.concatenate(ids), np.concatenate(ends)[words]

    def forget(self) -> None:
        """Give back what is remembered; the worker may do other work next."""
        self.cache = {}

    def encode_many(self, texts: list[str | None]) -> list[np.ndarray]:
        ids, begins = self.encode(pa.array(texts, pa.string()))
        return [ids[a:b] for a, b in zip(begins, begins[1:])]


@lru_cache(maxsize=1)
def tokenizer_for(path: str) -> WordTokenizer:
    """The tokenizer of a file, kept for the life of the Python worker."""
    return WordTokenizer(path)
