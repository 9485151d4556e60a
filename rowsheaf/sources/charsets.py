"""Names of encodings, and decoding one row's bytes by an expression inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from rowsheaf.plans.files import private_session

# Fixed values
SPARK_CHARSETS = {
    "utf-8": "UTF-8",
    "utf-8-sig": "UTF-8",
    "utf-16-le": "UTF-16LE",
    "utf-16-be": "UTF-16BE",
    "gbk": "GBK",
    "gb18030": "GB18030",
    "latin-1": "ISO-8859-1",
}
# Encodings whose line end is two bytes.
WIDE = ("utf-16-le", "utf-16-be")

# Characters that GBK leaves to its users, and the euro sign, which came later.
NOT_GBK = "[\ue000-\uf8ff€]"

# Charsets beyond the standard ones, and U+FFFD for bytes that are no character instead of an error.
CODING_SETTINGS = {"spark.sql.legacy.javaCharsets": "true", "spark.sql.legacy.codingErrorAction": "true"}


def coding_session(spark: SparkSession) -> SparkSession:
    """A session like ``spark`` in which :func:`decoded` and :func:`fits` know all of :data:`SPARK_CHARSETS`."""
    return private_session(spark, CODING_SETTINGS)


def charset_of(encoding: Column) -> Column:
    """The JVM's name of an encoding."""
    return F.create_map(*[F.lit(x) for pair in SPARK_CHARSETS.items() for x in pair])[encoding]


def decoded(raw: Column, charset: str | Column) -> Column:
    """Bytes as text; those that are no character become U+FFFD."""
    return F.call_function("decode", raw, F.lit(charset) if isinstance(charset, str) else charset)


def fits(raw: Column, charset: str) -> Column:
    """Whether bytes are text of ``charset``: then they are the same after decoding and encoding.

    The JVM's GBK also takes :data:`NOT_GBK`, a strict test doesn't.
    """
    text = decoded(raw, charset)
    same = F.encode(text, charset) == raw
    return same & ~text.rlike(NOT_GBK) if charset == "GBK" else same
