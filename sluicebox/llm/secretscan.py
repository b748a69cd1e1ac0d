"""Multipart credential linking: an interval join of identifiers, secrets and endpoints within scopes.

One regular expression decides which scopes can hold a secret at all; only those are searched
for the positions of all parts. Self-evident secrets are reported alone. A weak candidate (a
generic assignment such as a token or password) is reported only if an access identifier or an
endpoint stands in the same scope, however far. The intervals of a scope are joined by a sweep:
sorted by their start, each secret meets the part that ends last before it and the part that
begins next, so no pairs are made; positions come from running sums in the same exchange.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sluicebox.functions.text import let
from sluicebox.llm.common import digest, narrow

#: A scope ends at a blank line.
SCOPE = r"\n[ \t\r]*\n"
#: A name may have anything before its keyword (DB_PASSWORD, dbPassword) and a quote behind it (JSON); the match begins at the keyword.
PATTERNS = {
    "strong": r"-----BEGIN [A-Z ]*PRIVATE KEY-----|gh[pousr]_[A-Za-z0-9]{36}|xox[abprs]-[A-Za-z0-9-]{10,}|sk_live_[A-Za-z0-9]{16,}|eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}",
    "weak": r"""(?i:(?:token|secret|secret_access_key|password|passwd|pwd|api_?key)["']?[ \t]*[=:][ \t]*["']?)[A-Za-z0-9/+_.=-]{8,}""",
    "id": r"""\bAKIA[0-9A-Z]{16}\b|(?i:(?:client_id|access_key_id|username|user|account|login)["']?[ \t]*[=:][ \t]*["']?)[A-Za-z0-9_.@-]{3,}|[A-Za-z0-9][A-Za-z0-9._%+-]*@[A-Za-z0-9.-]+\.[A-Za-z]{2,}""",
    "endpoint": r"""(?i:https?|ftp|ssh|amqp|redis|mongodb|mysql|postgres|postgresql)://[^\s"'<>]+|\b[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\b|(?i:\b(?:host|server|endpoint)[ \t]*[=:][ \t]*["']?)[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+""",
}


def _matches(kind: str) -> Column:
    """The scope's matches in order, each with the length of the piece before it."""
    pattern = PATTERNS[kind]
    hits = lambda pieces: F.transform(F.regexp_extract_all("body", F.lit(pattern), F.lit(0)), lambda h, i: F.struct(F.lit(kind).alias("kind"), i.alias("i"), F.length(F.get(pieces, i)).alias("gap"), h.alias("value")))
    return let(F.split("body", pattern, -1), hits)


def credential_links(docs: DataFrame) -> DataFrame:
    """One row per reported secret: ``doc_id, scope, secret_start, secret_end, strength, n_ids, n_endpoints, distance, link, secret_sha256``.

    Scopes are the pieces between blank lines, numbered from 0; positions are characters within
    the scope, the end exclusive. ``n_ids`` and ``n_endpoints`` count the parts of the secret's
    scope; ``distance`` is the number of characters between the secret and the nearest of them: 0
    where they touch or overlap, null where there is none. ``link`` names the parts: secret,
    id+secret, secret+endpoint or id+secret+endpoint. The secret itself is given only as a hash.
    Null and empty texts give nothing. Rows equal in doc_id and text are one document. Extra
    columns are ignored.
    """
    rows = narrow(docs, "doc_id", "text").withColumn("doc_id", F.col("doc_id").cast("bigint"))
    secret = f"{PATTERNS['strong']}|{PATTERNS['weak']}"
    scopes = rows.where(F.col("text").rlike(secret)).withColumn("digest", digest()).dropDuplicates(["doc_id", "digest"])
    scopes = scopes.select("doc_id", "digest", F.posexplode(F.split("text", SCOPE, -1)).alias("scope", "body")).where(F.col("body").rlike(secret))
    found = scopes.select("doc_id", "digest", "scope", F.inline(F.concat(*[_matches(k) for k in PATTERNS])))
    # One exchange by scope serves all windows. A null doc_id is part of the digest, which so stands for the document.
    found = found.repartition("digest", "scope")
    ends = F.sum(F.col("gap") + F.length("value")).over(Window.partitionBy("digest", "scope", "kind").orderBy("i"))
    parts = found.withColumn("b", ends.cast("int")).withColumn("a", F.col("b") - F.length("value"))
    scope = Window.partitionBy("digest", "scope")
    other = lambda c: F.when(F.col("kind").isin("id", "endpoint"), F.col(c))
    # Both frames grow from their first row, so each is one pass.
    before = F.max(other("b")).over(scope.orderBy("a").rangeBetween(Window.unboundedPreceding, 0))
    after = F.min(other("a")).over(scope.orderBy(F.desc("a")).rangeBetween(Window.unboundedPreceding, -1))
    count = lambda kind: F.count_if(F.col("kind") == kind).over(scope).cast("int")
    out = parts.select("*", count("id").alias("n_ids"), count("endpoint").alias("n_endpoints"), before.alias("before"), after.alias("after"))
    out = out.where("kind = 'strong' or (kind = 'weak' and (n_ids > 0 or n_endpoints > 0))")
    gap = F.least(F.greatest(F.col("a") - F.col("before"), F.lit(0)), F.greatest(F.col("after") - F.col("b"), F.lit(0)))
    # greatest() passes over nulls: where one side has no part, the other one counts.
    gap = F.when(F.col("before").isNull() & F.col("after").isNull(), F.lit(None)).when(F.col("before").isNull(), F.greatest(F.col("after") - F.col("b"), F.lit(0))).when(F.col("after").isNull(), F.greatest(F.col("a") - F.col("before"), F.lit(0))).otherwise(gap)
    link = F.concat(F.when(F.col("n_ids") > 0, F.lit("id+")).otherwise(F.lit("")), F.lit("secret"), F.when(F.col("n_endpoints") > 0, F.lit("+endpoint")).otherwise(F.lit("")))
    return out.select("doc_id", "scope", F.col("a").alias("secret_start"), F.col("b").alias("secret_end"), F.col("kind").alias("strength"), "n_ids", "n_endpoints", gap.cast("int").alias("distance"), link.alias("link"), F.sha2("value", 256).alias("secret_sha256"))
