"""Token counts of texts under a unigram segmentation with a public vocabulary.

A text's pre-tokens are its runs between white space, each with the word mark in front; pieces never cross them. The
segmentation of a pre-token has the largest sum of piece scores, then the fewest tokens; a character in no piece counts
as one token for each of its bytes, at a score below all others.

The distinct new pre-tokens of a slice of texts, in sorted order, are a depth-first walk of their trie. The best score
and count of every prefix on the current path are kept, so a prefix shared by many pre-tokens is worked out once; the
counts at the ends of pre-tokens are stored, and a text's count is a sum over its pre-tokens. Tries are local to a task
and emptied at ``HELD`` entries: nothing is shuffled, and memory does not grow with the texts.

The vocabulary file is a parameter. Null text has no pre-tokens and counts 0, like empty text. Null ids and rows repeated
with one id are kept. An empty table gives an empty result; columns other than id and text are not read.
"""

from __future__ import annotations

from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MARK = "▁"
HELD = 400_000
SLICE_CHARACTERS = 1 << 20
_PENALTY = 10.0


class Vocabulary(NamedTuple):
    scores: dict[str, float]
    longest: int
    byte_score: float

    @classmethod
    def of(cls, scores: dict[str, float]) -> Vocabulary:
        return cls(scores, max(map(len, scores), default=1), min(scores.values(), default=0.0) - _PENALTY)

    @classmethod
    def load(cls, path: str | None = None) -> Vocabulary:
        """Pieces and scores of a SentencePiece file; by default the public one installed here."""
        import sentencepiece

        if path is None:
            import public_tokenizers

            path = public_tokenizers.path("piece_bpe_32k.model")
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        usable = (k for k in range(model.get_piece_size()) if not (model.is_control(k) or model.is_unknown(k) or model.is_byte(k)))
        return cls.of({model.id_to_piece(k): model.get_score(k) for k in usable})


def count_tokens(pretokens: list[str], vocabulary: Vocabulary) -> list[int]:
    """Tokens of each of the sorted, distinct pre-tokens."""
    scores, longest, byte_score = vocabulary
    find = scores.get
    # best[i] and number[i]: of the first i characters of the current path of the trie.
    best, number = [0.0], [0]
    out, before = [], ""
    for word in pretokens:
        shared = 0
        for a, b in zip(before, word, strict=False):
            if a != b:
                break
            shared += 1
        del best[shared + 1 :], number[shared + 1 :]
        for end in range(shared + 1, len(word) + 1):
            size = len(word[end - 1].encode())
            top, few = best[end - 1] + byte_score * size, number[end - 1] + size
            for start in range(max(0, end - longest), end):
                score = find(word[start:end])
                if score is not None:
                    score += best[start]
                    if score > top or (score == top and number[start] + 1 < few):
                        top, few = score, number[start] + 1
            best.append(top)
            number.append(few)
        out.append(number[-1])
        before = word
    return out


def token_counts(docs: DataFrame, vocabulary: Vocabulary, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, n_pretokens, n_tokens."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)  # as large as its file, whatever the texts

    def work(batches):
        held: dict[str, int] = {}
        for batch in batches:
            texts = batch.column(1).to_pylist()
            words, tokens, at = [], [], 0
            while at < len(texts):
                lists, size = [], 0
                while at < len(texts) and (not lists or size < SLICE_CHARACTERS):
                    lists.append((texts[at] or "").split())
                    size += len(texts[at] or "")
                    at += 1
                if len(held) > HELD:
                    held = {}
                new = sorted(set().union(*lists).difference(held))
                held.update(zip(new, count_tokens([MARK + w for w in new], shared.value), strict=True))
                words += map(len, lists)
                tokens += [sum(map(held.__getitem__, own)) for own in lists]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(words, pa.int64()), pa.array(tokens, pa.int64())], names=["doc_id", "n_pretokens", "n_tokens"])

    schema = f"doc_id {docs.schema[id_col].dataType.simpleString()}, n_pretokens bigint, n_tokens bigint"
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(work, schema)
