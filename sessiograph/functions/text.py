"""Lexical features of a segment text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..constants import NEGATIONS, PERSON_PRONOUNS, PRONOUNS, STOPWORDS_RU
from .scalars import col, safe_div

# any run of Unicode white space separates words
BLANKS = r"[\s\x0B\x1C-\x1F\x85\p{Z}]+"
WORD = r"[\p{L}\p{N}_]+"


class Split:
    """A text column whose words are already split into columns, so that many features share one split."""

    def __init__(self, text: str, words: str = "_words", lower: str = "_lower_words"):
        self.text, self.words, self.lower = text, words, lower

    def add_to(self, df: DataFrame) -> DataFrame:
        return df.withColumns({self.words: tokens(self.text), self.lower: lower_tokens(self.text)})


Text = str | Column | Split


def raw(text: Text) -> Column:
    return F.coalesce(col(text.text if isinstance(text, Split) else text), F.lit(""))


def tokens(text: Text) -> Column:
    if isinstance(text, Split):
        return F.col(text.words)
    return F.filter(F.split(raw(text), BLANKS), lambda w: w != "")


def lower_tokens(text: Text) -> Column:
    if isinstance(text, Split):
        return F.col(text.lower)
    return tokens(F.lower(col(text)))


def strip_blanks(text: str | Column) -> Column:
    return F.regexp_replace(F.coalesce(col(text), F.lit("")), rf"^{BLANKS}|{BLANKS}$", "")


def word_count(text: Text) -> Column:
    return F.size(tokens(text))


def unique_tokens(text: Text) -> Column:
    return F.size(F.array_distinct(lower_tokens(text)))


def type_token_ratio(text: Text) -> Column:
    n = word_count(text)
    return safe_div(unique_tokens(text).cast("double"), n.cast("double"))


def avg_word_length(text: Text) -> Column:
    t = tokens(text)
    total = F.aggregate(t, F.lit(0), lambda acc, w: acc + F.length(w))
    return safe_div(total.cast("double"), F.size(t).cast("double"))


def listed_count(text: Text, words: list[str]) -> Column:
    """How many tokens are in a fixed word list."""
    return F.size(F.filter(lower_tokens(text), lambda w: w.isin(*words)))


def pronoun_count(text: Text, language: str = "ru") -> Column:
    return listed_count(text, PRONOUNS[language])


def negation_count(text: Text, language: str = "ru") -> Column:
    return listed_count(text, NEGATIONS[language])


def person_pronouns(text: Text, lists: dict[str, list[str]] | None = None) -> dict[str, Column]:
    return {name: listed_count(text, words) for name, words in (lists or PERSON_PRONOUNS).items()}


def stopword_count(text: Text, words: list[str] | None = None) -> Column:
    return listed_count(text, words or STOPWORDS_RU)


def complex_word_count(text: Text, longer_than: int = 6) -> Column:
    return F.size(F.filter(tokens(text), lambda w: F.length(w) > longer_than))


def ratio_of_tokens(count: Column, text: Text) -> Column:
    return count / (word_count(text) + F.lit(1e-10))


def char_count(text: Text) -> Column:
    return F.length(raw(text))


def marks(text: Text, pattern: str) -> Column:
    return F.regexp_count(raw(text), F.lit(pattern))


def sentence_count(text: Text) -> Column:
    return marks(text, "[.!?]") + 1


def punctuation_ratio(text: Text) -> Column:
    return marks(text, "[!?.,;:]") / F.greatest(F.lit(1), char_count(text))


def speech_rate(text: Text, duration: str | Column) -> Column:
    return safe_div(word_count(text).cast("double"), col(duration))


def articulation_rate(text: Text, duration: str | Column, pause_ratio: str | Column) -> Column:
    return F.when(col(duration) > 0, safe_div(word_count(text).cast("double"), col(duration) * (1 - col(pause_ratio)))).otherwise(0.0)


def pause_ratio(words: str | Column, start: str | Column, end: str | Column) -> Column:
    """Share of the segment not covered by words; words with no or negative length do not count."""
    total = col(end) - col(start)
    spoken = F.aggregate(
        F.coalesce(col(words), F.array()), F.lit(0.0),
        lambda acc, w: acc + F.coalesce(F.greatest(F.lit(0.0), w["end"] - w["start"]), F.lit(0.0)))
    share = F.greatest(F.lit(0.0), total - spoken) / total
    return F.when((F.size(F.coalesce(col(words), F.array())) > 0) & (total > 0), F.least(F.lit(1.0), share)).otherwise(0.0)


def word_tokens(text: str | Column) -> Column:
    """Runs of letters, digits and underscore, lower case."""
    return F.regexp_extract_all(F.lower(F.coalesce(col(text), F.lit(""))), F.lit(WORD), F.lit(0))


def lexical_diversity(text: str | Column) -> Column:
    w = word_tokens(text)
    return safe_div(F.size(F.array_distinct(w)).cast("double"), F.size(w).cast("double"))


def clean_text(text: str | Column) -> Column:
    return strip_blanks(F.regexp_replace(F.lower(F.coalesce(col(text), F.lit(""))), "[.,!?;:“”\"'—–\\-«»]", ""))


def bag_of_words(text: str | Column, keywords: list[str], counts: bool = True) -> Column:
    t = lower_tokens(text)

    def count(k: str) -> Column:
        return F.size(F.filter(t, lambda w: w == k))

    return F.array(*[count(k) if counts else F.array_contains(t, k).cast("int") for k in keywords])


def segment_features(text: Text, duration: str | Column, pause: str | Column, language: str = "ru") -> dict[str, Column]:
    """The six lexical and prosodic columns of a merged segment row."""
    return {
        "speech_rate": speech_rate(text, duration),
        "articulation_rate": articulation_rate(text, duration, pause),
        "type_token_ratio": type_token_ratio(text),
        "pronoun_count": pronoun_count(text, language),
        "negation_count": negation_count(text, language),
        "avg_word_length": avg_word_length(text),
    }
