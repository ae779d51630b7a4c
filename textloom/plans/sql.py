"""DuckDB SQL fragments that mirror the tokenization profiles."""

from __future__ import annotations

from textloom.functions import tokens as T
from textloom.functions.tokens import Profile


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def accepts(profile: Profile, x: str) -> str:
    parts = [f"{x} <> ''"]
    if profile.whole is not None:
        parts.append(f"regexp_matches({x}, {quoted(f'^{T.WORD_CLASS}+$' if profile.whole else T.WORD_CLASS)})")
    if profile.longest:
        parts.append(f"length({x}) <= {profile.longest}")
    if profile.first:
        parts.append(f"regexp_matches(lower({x}[1]), {quoted(profile.first)})")
    return " AND ".join(parts)


def trimmed(profile: Profile, x: str) -> str:
    return f"trim({x}, {quoted(profile.trimmed)})" if profile.trimmed else x


def words(profile: Profile, table: str = "documents", text: str = "text", doc_id: str = "doc_id") -> str:
    """SELECT of doc_id, word, one row a token."""
    split = f"unnest(regexp_split_to_array({text}, {quoted(profile.delimiters)}))"
    inner = f"SELECT {doc_id} AS doc_id, {split} AS raw FROM {table} WHERE {text} IS NOT NULL"
    inner = f"SELECT doc_id, {trimmed(profile, 'raw')} AS tok FROM ({inner})"
    return f"SELECT doc_id, lower(tok) AS word FROM ({inner}) WHERE {accepts(profile, 'tok')}"


def word_list(profile: Profile, text: str = "text") -> str:
    """List of a text's words, in order."""
    return (
        f"list_transform(list_filter(list_transform(regexp_split_to_array({text}, {quoted(profile.delimiters)}), "
        f"lambda x: {trimmed(profile, 'x')}), lambda x: {accepts(profile, 'x')}), lambda x: lower(x))"
    )
