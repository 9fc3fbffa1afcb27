"""Text cleaning as native column expressions (no Python in the row path)."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from quizlens.values import (
    ECHO_AFTER,
    ECHO_BEFORE,
    END_OF_TEXT,
    RENDERED_PREFIX_EXCESS,
    WHITESPACE_CHARS,
)

# One class for all white space. Latin-1 members are listed one by one, which
# Java tests with one bit set; all others sit behind one range test, which most
# characters fail at once. A flat list of ranges takes more than twice as long.
_LATIN = "".join(c for c in WHITESPACE_CHARS if ord(c) < 256)
_WIDE = "".join(c for c in WHITESPACE_CHARS if ord(c) >= 256)
_WHITESPACE_RUN = f"[{_LATIN}[{min(_WIDE)}-{max(_WIDE)}&&[{_WIDE}]]]+"


def strip_text(text: Column) -> Column:
    """Remove all Unicode white space at both ends.

    ``trim`` with a character set reads each end once. A regular expression
    anchored at the end would rescan every inner run of blanks.
    """
    return F.trim(text, F.lit(WHITESPACE_CHARS))


def collapse_ws(text: Column) -> Column:
    """Turn each run of white space into one blank; the ends are not stripped."""
    return F.regexp_replace(text, _WHITESPACE_RUN, " ")


def drop_newlines(text: Column) -> Column:
    """Delete newlines without leaving a blank, then collapse what remains."""
    return collapse_ws(delete_newlines(text))


def delete_newlines(text: Column) -> Column:
    return F.replace(text, F.lit("\n"), F.lit(""))


def cut_at_marker(text: Column, marker: str = END_OF_TEXT) -> Column:
    """The text before the first marker, or all of it when there is none."""
    return F.substring_index(text, marker, 1)


def remove_echo(text: Column, prompt: Column) -> Column:
    """Delete every literal occurrence of the prompt."""
    return F.replace(text, prompt, F.lit(""))


def remove_wrapped_echo(text: Column, prompt: Column) -> Column:
    """Delete the prompt together with its instruction wrapper."""
    return remove_echo(text, F.concat(F.lit(ECHO_BEFORE), prompt, F.lit(ECHO_AFTER)))


def drop_prefix(text: Column, rendered_length: Column,
                excess: int = RENDERED_PREFIX_EXCESS) -> Column:
    """Drop the first ``rendered_length - excess`` characters.

    A negative count keeps that many characters at the end, as a Python slice
    with a negative start does.
    """
    start = rendered_length - F.lit(excess)
    return F.when(start < 0, F.right(text, -start)).otherwise(
        F.substring(text, start + F.lit(1), F.length(text))
    )


def record_line(*fields: Column, sep: str = "|") -> Column:
    """Join fields with the separator; a null field becomes empty, not skipped."""
    return F.concat_ws(sep, *[F.coalesce(f.cast("string"), F.lit("")) for f in fields])
