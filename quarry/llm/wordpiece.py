"""Token counts by a linear longest-match automaton.

A trie of the vocabulary gets failure links: where the walk cannot go on, the link of a node leads to
the node for what is left of the read characters after the longest pieces in front have been popped,
and the node knows how many pieces that pops. A word's greedy longest-match-first token count is the
sum of popped counts along one pass over its characters; no piece is ever built, and no character is
read twice.

Words are ``[^\\x20\\x09-\\x0D]+``; the first piece of a word comes from the pieces that start with the word
mark, later ones from the others. A word that cannot be covered is one unknown token. A null or empty
text has 0 tokens; a null doc_id is carried through; repeated rows and ties need no care: each row is
counted alone. Empty tables give no rows. Extra columns are ignored.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.shared import text_batches, worker_state

MARK = "▁"
CACHE_WORDS = 100_000


def vocabulary(path: str | None = None) -> list[str]:
    """Pieces of a public sentencepiece model without control, unknown and byte pieces."""
    import sentencepiece

    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("piece_bpe_32k.model")
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    plain = (i for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i)))
    return [model.id_to_piece(i) for i in plain]


class Automaton:
    """States are trie nodes; 0 is the root for continuing pieces, ``first`` the one for word starts."""

    def __init__(self, pieces: Iterable[str]):
        self.next: list[dict[str, int]] = [{}]
        ends: list[bool] = [False]
        parent: list[tuple[int, str]] = [(-1, "")]

        def add(root: int, text: str) -> None:
            at = root
            for ch in text:
                to = self.next[at].get(ch)
                if to is None:
                    to = self.next[at][ch] = len(self.next)
                    self.next.append({})
                    ends.append(False)
                    parent.append((at, ch))
                at = to
            ends[at] = True

        self.first = 1
        self.next.append({})
        ends.append(False)
        parent.append((-1, ""))
        for p in dict.fromkeys(pieces):
            if p.startswith(MARK):
                if len(p) > 1:
                    add(self.first, p[1:])
            elif p:
                add(0, p)
        # fail[n]: state after popping the longest pieces of the text read at n; popped[n]: how many.
        n = len(self.next)
        self.fail, self.popped = [-1] * n, [0] * n
        queue = deque(c for root in (0, self.first) for c in self.next[root].values())
        while queue:
            at = queue.popleft()
            queue.extend(self.next[at].values())
            if ends[at]:
                self.fail[at], self.popped[at] = 0, 1
                continue
            up, ch = parent[at]
            # What is left at the parent, moved on by this character.
            state, count = self.fail[up], self.popped[up]
            while state >= 0 and ch not in self.next[state]:
                state, count = self.fail[state], count + self.popped[state]
            if state >= 0:
                self.fail[at], self.popped[at] = self.next[state][ch], count
        # The root for continuing pieces has no link: a walk that arrives there with a character it cannot
        # read fails for good.

    def count(self, word: str) -> int:
        """Greedy longest-match pieces of a word; 1 for a word that cannot be covered."""
        at, count, step, fail, popped = self.first, 0, self.next, self.fail, self.popped
        for ch in word:
            while True:
                to = step[at].get(ch)
                if to is not None:
                    at = to
                    break
                if fail[at] < 0:
                    return 1
                count += popped[at]
                at = fail[at]
        while at != 0:
            if fail[at] < 0:
                return 1
            count += popped[at]
            at = fail[at]
        return count


def greedy_count(word: str, pieces: set[str]) -> int:
    """The rule itself, quadratic in the word: for tests."""
    at, count = 0, 0
    while at < len(word):
        for end in range(len(word), at, -1):
            if (word[at:end] if at else MARK + word[:end]) in pieces:
                at, count = end, count + 1
                break
        else:
            return 1
    return count


def token_counts(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_words, n_tokens, n_unknown (words that are one unknown token)."""

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        kept = worker_state().setdefault("automata", {})  # one per Python worker, shared by its tasks
        if path not in kept:
            pieces = vocabulary(path)
            kept[path] = Automaton(pieces), set(pieces)
        automaton, whole = kept[path]
        known: dict[bytes, tuple[int, int]] = {}

        def look(w: bytes) -> tuple[int, int]:
            if len(known) > CACHE_WORDS:
                known.clear()
            word = w.decode("utf-8", "surrogatepass")
            n = automaton.count(word)
            # A count of 1 is a whole piece or an unknown word.
            known[w] = (n, int(n == 1 and MARK + word not in whole))
            return known[w]

        for b in batches:
            rows = []
            for text in b["text"]:
                found = text.encode("utf-8", "surrogatepass").split() if text else []
                pairs = [known.get(w) or look(w) for w in found]
                rows.append((len(found), sum(p[0] for p in pairs), sum(p[1] for p in pairs)))
            out = pd.DataFrame(rows, columns=["n_words", "n_tokens", "n_unknown"])
            out.insert(0, "doc_id", b["doc_id"].astype("Int64").mask(b["null_id"]).array)
            yield out

    text_batches(docs.sparkSession)
    slim = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("doc_id"), F.col("doc_id").isNull().alias("null_id"), F.col("text").cast("string").alias("text"))
    return slim.mapInPandas(run, "doc_id long, n_words long, n_tokens long, n_unknown long")
