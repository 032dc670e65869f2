"""Pieces of oversized texts, cut at the strongest boundary that keeps a piece under its token limit.

A text's pre-tokens (units) are written as one character per token: `x` inside a unit, and behind a unit the strength of
the boundary there - S section, P paragraph, N line, W word, C character. One regular expression over that string does
the cutting: for each strength, strongest first, a bounded quantifier takes as much as the limit allows, down to half of
it; behind them stands the fallback to any unit end. The overlap is a look-back of OVERLAP tokens from each cut, moved
forward to the next unit end, and is computed with array functions, as are the character ranges of the pieces.

Units are cut from each other only where the tokenizer separates them too, so a piece has at most the tokens counted
for it (one less where the white space that ends it joins up at the cut). A unit of more than UNIT_TOKENS tokens, or of more
than a piece has room for, is cut into units of UNIT_CHARS characters or, where these are still too large, of one, each
counted by its own encoding. A text whose pieces would not cover it raises an error instead of losing a part.

Defined results: null and empty texts give no piece; a text within the limit gives itself as its only piece; a limit must leave
room for MOST_BYTES tokens beside the overlap, as one character can have as many; rows that repeat an id repeat their pieces; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.llm.byte_bpe import broadcast_ranks, encoder

LIMIT, OVERLAP = 2048, 64
UNIT_TOKENS, UNIT_CHARS, MOST_BYTES = 256, 16, 4
_END = r"(?:\r\n|\r|\n|\Z)"
_HEADING = re.compile(
    rf"#{{1,6}}[ \t]|={{3,}}|-{{3,}}[ \t]*{_END}|\[[^\]\r\n]+\][ \t]*{_END}|[^\r\n]++(?:\r\n|\r|\n)(?:={{3,}}|-{{3,}})[ \t]*{_END}"
)
#: Signs that end a clause in scripts that are written without blanks.
STOPS = tuple("。、！？，；：」』）")


def cutting_pattern(limit: int, overlap: int) -> str:
    """The expression that cuts a boundary string into pieces; the first piece has no overlap to leave room for."""

    def alternatives(most: int) -> str:
        least = most // 2
        return "|".join([f".{{1,{most}}}$", *[f".{{{least},{most - 1}}}{c}" for c in "SPNW"], f".{{0,{most - 1}}}[SPNWC]"])

    return f"^(?:{alternatives(limit)})|(?:{alternatives(limit - overlap)})"


def boundary(text: str, end: int) -> str:
    """Strength of the boundary at a unit's end."""
    after, before = text[end : end + 1], text[end - 1 : end]
    if after in ("\n", "\r") and after:  # the line's end belongs to the piece before it
        return "W"
    if before in ("\n", "\r") and before:
        if _HEADING.match(text, end):
            return "S"
        at, ends = end, 0
        while at > 0 and ends < 2 and text[at - 1] in " \t\r\n":
            at -= 1
            ends += text[at] == "\n" or text[at] == "\r" and text[at + 1 : at + 2] != "\n"
        return "P" if ends > 1 else "N"
    if before.isspace() or after.isspace() or before in STOPS:
        return "W"
    return "C"


def units(text: str, pre: list[str], sizes: list[int], enc, most: int = UNIT_TOKENS) -> tuple[list[int], list[int], str]:
    """Token and character ends of the units, none of more than `most` tokens, and the boundary string."""
    tokens, chars, marks = [], [], []
    token = char = 0
    for word, size in zip(pre, sizes):
        parts = [(word, size)]
        if size > most:
            parts = []
            for i in range(0, len(word), UNIT_CHARS):
                part = word[i : i + UNIT_CHARS]
                n = len(enc.encode(part))
                parts += [(part, n)] if n <= most else [(c, len(enc.encode(c))) for c in part]
        for part, n in parts:
            token, char = token + n, char + len(part)
            tokens.append(token)
            chars.append(char)
            marks.append("x" * (n - 1) + boundary(text, char))
    return tokens, chars, "".join(marks)


def boundary_strings(
    df: DataFrame, id_column: str, text_column: str, folder: str | None, limit: int, overlap: int, whole: bool
) -> DataFrame:
    """(id, text, tokens array<int>, chars array<int>, marks) of the texts that have more than `limit` tokens; with `whole`
    also of the others that are not empty, each as one unit of one token."""
    most = min(UNIT_TOKENS, limit - overlap)
    if overlap < 0 or most < MOST_BYTES:
        raise ValueError(f"a limit of {limit} with an overlap of {overlap} leaves no room for a character of {MOST_BYTES} tokens")
    ranks = broadcast_ranks(df.sparkSession, folder)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(ranks.value)
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                out = []
                for key, text in zip(*(batch.column(k).slice(start, 256).to_pylist() for k in (0, 1))):
                    # a token has at least one byte, so a text of no more bytes than the limit needs no encoding
                    if len(text) > limit or len(text.encode("utf-8", "replace")) > limit:
                        pre = enc.pretokens(text)
                        sizes = enc.sizes(pre)
                        if sum(sizes) > limit:
                            out.append((key, text, *units(text, pre, sizes, enc, most)))
                            continue
                    if whole:
                        out.append((key, text, [1], [len(text)], "C"))
                columns = list(zip(*out)) if out else [[]] * 5
                kinds = [batch.column(0).type, pa.string(), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.string()]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(columns, kinds)], names=["id", "text", "tokens", "chars", "marks"]
                )

    kind = df.schema[id_column].dataType.simpleString()
    wide = df.where(F.octet_length(df[text_column]) > (0 if whole else limit))
    wide = wide.select(df[id_column].alias("id"), df[text_column].alias("text"))
    return wide.mapInArrow(run, f"id {kind}, text string, tokens array<int>, chars array<int>, marks string")


def _char_at(token: Column) -> Column:
    """Character offset of a token offset that is a unit's end."""
    return F.when(token == 0, F.lit(0)).otherwise(
        F.element_at("chars", F.array_position("tokens", token).cast("int"))
    )


def oversized_pieces(
    df: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    limit: int = LIMIT,
    overlap: int = OVERLAP,
    folder: str | None = None,
    whole: bool = False,
) -> DataFrame:
    """(id, piece, pieces, first_char, overlap_tokens, tokens, text) of the texts that exceed the limit; with `whole` also of
    the others, whose only piece is counted as one token."""
    strings = boundary_strings(df, id_column, text_column, folder, limit, overlap, whole)
    lengths = F.transform(
        F.regexp_extract_all("marks", F.lit(cutting_pattern(limit, overlap)), F.lit(0)), lambda p: F.length(p)
    )
    ends = F.aggregate(
        lengths,
        F.array(F.lit(0)),
        lambda done, n: F.concat(done, F.array(F.element_at(done, -1) + n)),
    )
    covered = F.element_at(ends, -1) == F.length("marks")
    cut = strings.withColumn("ends", F.when(covered, ends).otherwise(F.raise_error(F.lit("pieces do not cover a text")).cast("array<int>")))
    piece = cut.select("*", F.posexplode(F.slice("ends", 2, F.size("ends"))).alias("piece", "stop"))
    begin = F.element_at("ends", F.col("piece") + 1)  # where the piece's own tokens begin
    back = F.greatest(begin - overlap, F.lit(0))
    # the first unit end at or after the look-back: the `x`s from there on are inside a unit
    inside = F.when(back == 0, 0).otherwise(
        F.length(F.regexp_extract(F.substring(F.col("marks"), back, begin - back + 1), "^x*", 0))
    )
    start = F.least(begin, back + inside)
    placed = piece.select(
        "id", "text", "tokens", "chars", "stop", "piece", (F.size("ends") - 1).alias("pieces"), begin.alias("begin"), start.alias("start")
    )
    ranged = placed.select("*", _char_at(F.col("start")).alias("first_char"), _char_at(F.col("stop")).alias("last_char"))
    return ranged.select(
        F.col("id").alias(id_column),
        "piece",
        "pieces",
        "first_char",
        (F.col("begin") - F.col("start")).alias("overlap_tokens"),
        (F.col("stop") - F.col("start")).alias("tokens"),
        F.substring(F.col("text"), F.col("first_char") + 1, F.col("last_char") - F.col("first_char")).alias("text"),
    )


def split_texts(df: DataFrame, id_column: str = "doc_id", text_column: str = "text", folder: str | None = None) -> DataFrame:
    """Pieces of all texts that are not empty, in one pass; a text within the limit is its own piece."""
    pieces = oversized_pieces(df, id_column, text_column, folder=folder, whole=True)
    return pieces.select(id_column, "piece", "pieces", "first_char", "overlap_tokens", "text")
