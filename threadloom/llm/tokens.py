"""Token ids of whole texts, exactly those of the tokenizers library.

The tokenizer in use drops white space before it splits a text, and no merge crosses white space, so a
text's ids are those of its blank-separated words one after another.  Arrow splits a batch of texts and finds
its distinct words; only distinct words that the worker has not met reach the library.  Texts that hold a
special token's string go to the library whole.
"""

from __future__ import annotations

import json
import os
from unicodedata import normalize

#: The tokenizer file that the contracts name.
VOCABULARY = "word_bpe_49k.json"
CACHE_WORDS = 500_000
#: Text bytes handled at once.
STEP_BYTES = 12 << 20
#: ASCII characters that are neither letters, digits nor blanks: a run of them after a letter or digit is split
#: off by the tokenizer as well, so both parts can be encoded apart.
_TAIL = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum())
#: Last characters before such a run: letters and digits that normalising and lower case leave letters and digits.
_BEFORE_TAIL = "[0-9A-Za-z\u00C0-\u00D6\u00D8-\u00F6\u00F8-\u012F\u0131-\u024F\u0400-\u0481\u4E00-\u9FFF]$"

_encoders: dict[str, "WordEncoder"] = {}


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(VOCABULARY)


def encoder(path: str | None = None) -> "WordEncoder":
    """The worker's encoder for a file; kept between tasks."""
    path = path or default_path()
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]


class WordEncoder:
    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        self.library = Tokenizer.from_file(path)
        self.marks = [t.content for t in self.library.get_added_tokens_decoder().values()]
        suffix = getattr(self.library.model, "end_of_word_suffix", None)
        #: Ids that end a word.
        self.ends = frozenset(i for t, i in self.library.get_vocab().items() if suffix and t.endswith(suffix))
        parts = json.loads(self.library.to_str())
        splits = [x.get("type") for x in parts["pre_tokenizer"].get("pretokenizers", [parts["pre_tokenizer"]])]
        if not self.ends or splits != ["Split", "ByteLevel"] or parts["pre_tokenizer"]["pretokenizers"][0]["behavior"] != "Removed":
            raise ValueError("this encoder needs a tokenizer that drops white space and marks the ends of words")
        #: The same model without the patterns that find words: for words of letters parted by blanks.
        self.plain = Tokenizer.from_file(path)
        self.plain.normalizer = normalizers.Sequence([normalizers.NFC(), normalizers.Lowercase()])
        by_byte = pre_tokenizers.ByteLevel(add_prefix_space=False, trim_offsets=True, use_regex=False)
        self.plain.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), by_byte])
        self.known: dict[str, bytes] = {}

    def whole(self, texts: list[str]) -> list[bytes]:
        """Ids of texts straight from the library, as little-endian unsigned 32-bit integers."""
        import numpy as np

        return [np.array(e.ids, "<u4").tobytes() for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def _letters(self, words: list[str]) -> list[bytes]:
        """Ids of words of letters only.  Each is one token run that a word end closes, so that many go as one text."""
        import numpy as np

        out: list[bytes] = []
        for lo in range(0, len(words), 512):
            some = words[lo : lo + 512]
            ids = self.plain.encode_batch_fast([" ".join(some)], add_special_tokens=False)[0].ids
            stops = [4 * i for i, x in enumerate(ids, 1) if x in self.ends]
            if len(stops) != len(some) or stops[-1] != 4 * len(ids):
                out += self.whole(some)
                continue
            raw, at = np.array(ids, "<u4").tobytes(), 0
            for stop in stops:
                out.append(raw[at:stop])
                at = stop
        return out

    def _ids_of(self, words: list[str]) -> list[bytes]:
        known = self.known
        new = [w for w in words if w not in known]
        if new:
            if len(known) + len(new) > CACHE_WORDS:
                known.clear()
                new = words
            plain, other = [], []
            for w in new:
                (plain if w.isalpha() and (w.isascii() or normalize("NFC", w).lower().isalpha()) else other).append(w)
            known.update(zip(plain, self._letters(plain)))
            known.update(zip(other, self.whole(other)))
        return [known[w] for w in words]

    def _step(self, texts):
        """Ids of each text of an Arrow array, as an Arrow array of bytes."""
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        lists = pc.ascii_split_whitespace(texts)
        coded = pc.dictionary_encode(lists.flatten())
        words = coded.dictionary
        cores = pc.utf8_rtrim(words, characters=_TAIL)
        cores = pc.if_else(pc.match_substring_regex(cores, _BEFORE_TAIL), cores, words)
        tails = _rest(words, cores)
        cores = pc.if_else(pc.string_is_ascii(cores), pc.ascii_lower(cores), cores)
        found = []
        for part in (cores, tails):
            own = pc.dictionary_encode(part)
            found.append(pa.array(self._ids_of(own.dictionary.to_pylist()), pa.binary()).take(own.indices))
        ids = pc.binary_join_element_wise(*found, b"").take(coded.indices)
        starts = np.frombuffer(ids.buffers()[1], np.int32, len(ids) + 1, ids.offset * 4) if len(ids) else np.zeros(1, np.int32)
        lens = pc.list_value_length(lists).to_numpy(zero_copy_only=False)
        bounds = starts[np.concatenate([[0], np.cumsum(lens)]).astype(np.int64)]
        data = ids.buffers()[2] if len(ids) and ids.buffers()[2] is not None else pa.py_buffer(b"")
        return pa.BinaryArray.from_buffers(pa.binary(), len(texts), [None, pa.py_buffer(bounds.astype(np.int32).tobytes()), data])

    def encode(self, texts) -> list[bytes]:
        """Ids of each text (an Arrow array or a list) as little-endian unsigned 32-bit integers; null counts as empty."""
        import pyarrow as pa
        import pyarrow.compute as pc

        texts = texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string())
        texts = pc.fill_null(texts, "")
        sizes = pc.binary_length(texts).to_pylist()
        out: list[bytes] = []
        lo = 0
        while lo < len(texts):
            hi, held = lo, 0
            while hi < len(texts) and (hi == lo or held + sizes[hi] <= STEP_BYTES):
                held += sizes[hi]
                hi += 1
            some = texts.slice(lo, hi - lo)
            got = self._step(some).to_pylist()
            for mark in self.marks:
                for i in pc.indices_nonzero(pc.match_substring(some, mark)).to_pylist():
                    got[i] = self.whole([some[i].as_py()])[0]
            out += got
            lo = hi
        return out


def _rest(words, cores):
    """What ``words`` have beyond ``cores``, which begin them; the rest is ASCII."""
    import numpy as np
    import pyarrow as pa

    if not len(words):
        return words
    a = np.frombuffer(words.buffers()[1], np.int32, len(words) + 1, words.offset * 4)
    n = np.diff(np.frombuffer(cores.buffers()[1], np.int32, len(cores) + 1, cores.offset * 4))
    data = np.frombuffer(words.buffers()[2] or b"", np.uint8)
    lens = np.diff(a) - n
    starts = np.concatenate([[0], np.cumsum(lens)])
    take = np.repeat(a[:-1] + n - starts[:-1], lens) + np.arange(starts[-1])
    return pa.StringArray.from_buffers(len(words), pa.py_buffer(starts.astype(np.int32).tobytes()), pa.py_buffer(data[take].tobytes()))
