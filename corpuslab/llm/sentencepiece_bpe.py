"""SentencePiece BPE encoding with a prefix table, and decoding.

The encoding of a text's prefix ends in one token, and that token is the only vocabulary
entry that ends there and is compatible with the last token of the prefix before it: the
pair of them, merged on its own, stays as it is. So one pass of an automaton that lists
the entries ending at each character fills a table of last tokens, and the ids are read
off the table backwards. Each pair is merged once and then remembered.

No entry goes on after a word's end, so texts are cut before each run of white space and
equal words are encoded once while they are remembered.
"""

from __future__ import annotations

import hashlib
import re

from pyspark.sql import DataFrame, types as T

from corpuslab.llm.common import map_text

MARK = "▁"
# Pairs that an encoder remembers, and a fifth as many words.
REMEMBERED = 1_000_000
UNIT = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")


class Automaton:
    """Lists the entries that end at each character of a text, the longest first.

    A node has a dictionary of next nodes; steps found by way of shorter suffixes are
    added to it when they are first taken.
    """

    def __init__(self, entries: dict[str, int]):
        self.next: list[dict[str, int]] = [{}]
        own: dict[int, tuple[int, int]] = {}
        for text, number in entries.items():
            node = 0
            for c in text:
                step = self.next[node].get(c)
                if step is None:
                    step = self.next[node][c] = len(self.next)
                    self.next.append({})
                node = step
            own[node] = len(text), number
        self.suffix = [0] * len(self.next)
        self.ends: list[list[tuple[int, int]]] = [[] for _ in self.next]
        level = [0]
        while level:
            below = []
            for node in level:
                for c, step in self.next[node].items():
                    back = self.suffix[node]
                    while back and c not in self.next[back]:
                        back = self.suffix[back]
                    found = self.next[back].get(c, 0)
                    self.suffix[step] = found if found != step else 0
                    self.ends[step] = [own[step]] if step in own else []
                    self.ends[step] += self.ends[self.suffix[step]]
                    below.append(step)
            level = below

    def step(self, node: int, c: str) -> int:
        back = node
        while back and c not in self.next[back]:
            back = self.suffix[back]
        to = self.next[back].get(c, 0)
        if to:
            self.next[node][c] = to
        return to


class Encoder:
    """Encodes and decodes with the vocabulary of a SentencePiece BPE model."""

    def __init__(self, model: bytes, remembered: int = REMEMBERED):
        import sentencepiece

        self.remembered = remembered
        self.model = sentencepiece.SentencePieceProcessor(model_proto=model)
        m = self.model
        self.bytes = {m.id_to_piece(i): i for i in range(len(m)) if m.is_byte(i)}
        plain = [i for i in range(len(m)) if not (m.is_byte(i) or m.is_control(i) or m.is_unknown(i) or m.is_unused(i))]
        self.piece = {i: m.id_to_piece(i) for i in plain}
        self.rank = {p: m.get_score(i) for i, p in self.piece.items()}
        self.id = {p: i for i, p in self.piece.items()}
        if any(MARK in p.lstrip(MARK) or (MARK * 2 in p and p.strip(MARK)) for p in self.id):
            raise ValueError("a vocabulary entry crosses a word's end")
        if any(c not in self.id for p in self.id for c in p):
            raise ValueError("a vocabulary entry has a character that is no entry")
        self.history: dict[int, tuple[list, list[str], list[str]]] = {}
        reached = {}
        for p, i in self.id.items():
            self.history[i], whole = self.merge(p)
            if whole:
                reached[p] = i
        self.automaton = Automaton(reached)
        self.pairs: dict[int, bool] = {}
        self.words: dict[str, tuple[int, ...]] = {}
        self.older: dict[str, tuple[int, ...]] = {}

    def merge(self, text: str) -> tuple[tuple[list, list[str], list[str]], bool]:
        """Merge a text alone: the best-scored adjacent pair first, the leftmost of equal ones.

        Returns the score of each merge, then None, with the first and the last part before
        it, and whether one part remains.
        """
        parts = list(text)
        scores, firsts, lasts = [], [], []
        rank = self.rank.get
        while True:
            best, at = None, -1
            for i in range(len(parts) - 1):
                score = rank(parts[i] + parts[i + 1])
                if score is not None and (best is None or score > best):
                    best, at = score, i
            scores.append(best)
            firsts.append(parts[0])
            lasts.append(parts[-1])
            if best is None:
                return (scores, firsts, lasts), len(parts) == 1
            parts[at : at + 2] = [parts[at] + parts[at + 1]]

    def compatible(self, a: int, b: int) -> bool:
        """Whether merging the two entries' joined text leaves them as they are.

        Up to the first merge across the border each side merges as it does alone, so the
        two histories are played side by side; of equal scores the left one comes first.
        """
        left, _, lasts = self.history[a]
        right, firsts, _ = self.history[b]
        rank = self.rank.get
        i = j = 0
        while True:
            x, y, across = left[i], right[j], rank(lasts[i] + firsts[j])
            if across is not None and (x is None or across > x) and (y is None or across >= y):
                return False
            if x is not None and (y is None or x >= y):
                i += 1
            elif y is not None:
                j += 1
            else:
                return True

    def encode_word(self, word: str) -> tuple[int, ...]:
        """Ids of a text without inner word ends, by the table of last tokens."""
        n = len(word)
        # sizes[i], last[i]: the token that ends the encoding of the first i characters; -1: no entry, its bytes
        sizes = [0] * (n + 1)
        last = [-1] * (n + 1)
        pairs, vocabulary = self.pairs, len(self.model)
        steps, ends, step = self.automaton.next, self.automaton.ends, self.automaton.step
        node = 0
        for end, c in enumerate(word, 1):
            to = steps[node].get(c)
            node = step(node, c) if to is None else to
            for size, token in ends[node]:
                before = last[end - size]
                if before >= 0:
                    key = before * vocabulary + token
                    fits = pairs.get(key)
                    if fits is None:
                        if len(pairs) >= self.remembered:
                            pairs.clear()
                        fits = pairs[key] = self.compatible(before, token)
                    if not fits:
                        continue
                sizes[end] = size
                last[end] = token
                break
        out: list[int] = []
        at = n
        while at:
            token = last[at]
            if token >= 0:
                out.append(token)
                at -= sizes[at]
            else:
                out.extend(self.bytes[f"<0x{b:02X}>"] for b in reversed(word[at - 1].encode()))
                at -= 1
        out.reverse()
        return tuple(out)

    def word(self, word: str) -> tuple[int, ...]:
        """Two generations of remembered words, so that frequent ones stay."""
        ids = self.older.get(word)
        if ids is None:
            ids = self.encode_word(word)
        if len(self.words) >= self.remembered // 5:
            self.older, self.words = self.words, {}
        if len(word) <= 64:
            self.words[word] = ids
        return ids

    def encode(self, text: str | None) -> list[int]:
        """Ids of a whole text; none for a null or empty one."""
        if not text:
            return []
        out: list[int] = []
        extend, get = out.extend, self.words.get
        for unit in UNIT.findall(MARK + text.replace(" ", MARK)):
            ids = get(unit)
            if ids is None:
                ids = self.word(unit)
                get = self.words.get
            extend(ids)
        return out

    def decode(self, ids: list[int]) -> str:
        return self.model.decode(ids) if ids else ""


def encoder_of(shared: dict, remembered: int = REMEMBERED) -> Encoder:
    """The encoder of a broadcast {"model": bytes}. All tasks of a worker process share it and what it remembers."""
    if "encoder" not in shared:
        shared["encoder"] = Encoder(shared["model"], remembered)
    return shared["encoder"]


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def read_model(path: str | None = None) -> dict:
    """The model file, read once by the driver and sent to the tasks (0.5 MB for 32,000 entries)."""
    with open(path or default_model(), "rb") as f:
        return {"model": f.read()}


def tokenized(
    docs: DataFrame, text: str = "text", model: str | None = None, keep: list[str] | None = None, remembered: int = REMEMBERED
) -> DataFrame:
    """Add ``ids`` (array of int) and ``decoded`` (string); null and empty texts have no ids.

    A task remembers the tests of up to ``remembered`` pairs of entries and the ids of a fifth as many words
    twice; with fewer it takes less memory and more time.
    """
    shared = docs.sparkSession.sparkContext.broadcast(read_model(model))

    def make():
        encoder = encoder_of(shared.value, remembered)

        def work(texts):
            ids = [encoder.encode(t) for t in texts]
            return [ids, [encoder.decode(i) for i in ids]]

        return work

    fields = [T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("decoded", T.StringType())]
    return map_text(docs, text, fields, make, keep, tidy=True)


def digests(docs: DataFrame, text: str = "text", model: str | None = None, keep: list[str] | None = None) -> DataFrame:
    """Add ``n_tokens``, ``ids_sha256`` and ``decoded_sha256``, computed where the ids are."""
    shared = docs.sparkSession.sparkContext.broadcast(read_model(model))

    def make():
        encoder = encoder_of(shared.value)
        number = [str(i) for i in range(len(encoder.model))]

        def sha(s: str) -> str:
            return hashlib.sha256(s.encode("utf-8", "replace")).hexdigest()

        def work(texts):
            counts, ids_sha, text_sha = [], [], []
            for t in texts:
                ids = encoder.encode(t)
                counts.append(len(ids))
                ids_sha.append(sha(",".join(map(number.__getitem__, ids))))
                text_sha.append(sha(encoder.decode(ids)))
            return [counts, ids_sha, text_sha]

        return work

    fields = [T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())]
    return map_text(docs, text, fields, make, keep)


def op4_sentencepiece(spark, sf_dir):
    return digests(spark.read.parquet(f"{sf_dir}/documents.parquet"), keep=["doc_id"])
