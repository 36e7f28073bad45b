"""Fetch error texts put into classes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values: (pattern looked for, class reported), first hit wins.
ERROR_CLASSES = (
    ("Could not resolve host", "Could not resolve host"),
    ("Resolving timed out after", "Resolving timeout"),
    ("Operation timed out after", "Operation timeout"),
    ("Connection timed out after", "Connection timeout"),
    ("Error in protocol version", "gnutls: protocol version error"),
    ("server certificate verification failed", "gnutls: certificate verification failed"),
    ("The server name sent was not recognized", "gnutls: server name not recognized"),
    ("The TLS connection was non-properly terminated", "gnutls: termination error"),
    (r"gnutls_handshake\(\) failed: Handshake failed", "gnutls: handshake failed"),
    (
        r"gnutls_handshake\(\) failed: A record packet with illegal version was received",
        "gnutls: handshake fail, illegal version",
    ),
    (
        "does not match target host name.*SSL: certificate subject name",
        "ssl: certificate subject mismatch",
    ),
    ("Failed to connect to .*No route to host", "no route to host"),
    ("Failed to connect to .*Connection refused", "connection refused"),
    (
        r"gnutls_handshake\(\) failed: Error in the pull function\.",
        "gnutls: handshake fail in pull",
    ),
    (
        r"gnutls_handshake\(\) failed: Internal error",
        "gnutls: handshake fail internal error",
    ),
    ("Empty reply from server", "empty reply"),
)


def error_category(short: Column, full: Column) -> Column:
    """Class of an error text; unknown texts come back whole."""
    chain = F.when(full.isNull(), F.lit(None).cast("string"))
    for pattern, name in ERROR_CLASSES:
        chain = chain.when(full.rlike(pattern), F.lit(name))
    return chain.otherwise(
        F.format_string(
            "Fetcher subprocess error: %s\n%s", F.coalesce(short, F.lit("")), full
        )
    )
