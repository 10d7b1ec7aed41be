"""Typed errors. Their text never holds a cell value."""

from __future__ import annotations

import re
from collections.abc import Iterator
from contextlib import contextmanager
from enum import Enum


class Category(Enum):
    """Value: whether a run that failed so may be tried again."""

    INVALID_REQUEST = ("invalid_request", False)
    INVALID_PLAN = ("invalid_plan", False)
    TYPE_ERROR = ("type_error", False)
    UNSUPPORTED = ("unsupported", False)
    NOT_FOUND = ("not_found", False)
    INVALID_DATA = ("invalid_data", False)
    SCHEMA_DRIFT = ("schema_drift", False)
    CAST_FAILURE = ("cast_failure", False)
    LIMIT_EXCEEDED = ("limit_exceeded", False)
    AUTHENTICATION = ("authentication", False)
    AUTHORIZATION = ("authorization", False)
    RATE_LIMITED = ("rate_limited", True)
    TIMEOUT = ("timeout", True)
    TRANSIENT_SOURCE = ("transient_source", True)
    BUSY = ("busy", True)
    CANCELLED = ("cancelled", True)
    DEADLINE = ("deadline_exceeded", True)
    STORAGE = ("storage", True)
    INTERNAL = ("internal", False)


class CleaningError(Exception):
    def __init__(self, category: Category, message: str):
        super().__init__(f"{category.value[0]}: {message}")
        self.category = category

    @property
    def retryable(self) -> bool:
        return self.category.value[1]


def fail(category: Category, message: str):
    raise CleaningError(category, message)


_SECRET_WORDS = ("password", "passwd", "secret", "token", "api_key", "apikey", "access_key", "private_key", "credential", "authorization", "connection_string")
_SECRET_VALUE = re.compile(r"(?i)\b(?:bearer\s+\S+|basic\s+[a-z0-9+/=]{8,}|akia[0-9a-z]{16}|-----begin [a-z ]*private key)|://[^/\s:@]+:[^/\s@]+@")


def secret_key(text: str) -> bool:
    """Whether a name looks like that of a secret."""
    flat = text.lower().replace("-", "_")
    return any(w in flat for w in _SECRET_WORDS)


def secret_value(text: str) -> bool:
    """Whether a text looks like a secret."""
    return bool(_SECRET_VALUE.search(text)) or any(f"{w}=" in text.lower() for w in _SECRET_WORDS)


_SPARK = (
    (("CAST_INVALID_INPUT", "CAST_OVERFLOW", "CANNOT_PARSE_TIMESTAMP"), Category.CAST_FAILURE, "a value can't be cast"),
    (("ARITHMETIC_OVERFLOW", "BINARY_ARITHMETIC_OVERFLOW", "DIVIDE_BY_ZERO", "REMAINDER_BY_ZERO", "INTERVAL_DIVIDED_BY_ZERO"), Category.INVALID_DATA, "an arithmetic result is out of range or a divisor is zero"),
    (("MALFORMED_RECORD", "FAILED_READ_FILE", "MALFORMED_CSV_RECORD", "CANNOT_READ_FILE_FOOTER"), Category.INVALID_DATA, "a file can't be read as its format"),
    (("PATH_NOT_FOUND", "FileNotFoundException"), Category.NOT_FOUND, "a path isn't there"),
    (("AccessControlException", "AccessDeniedException", "AccessDenied", "403 Forbidden"), Category.AUTHORIZATION, "a source refuses access"),
    (("InvalidAccessKeyId", "SignatureDoesNotMatch", "401 Unauthorized", "Unable to load credentials"), Category.AUTHENTICATION, "a source doesn't know the credentials"),
    (("SlowDown", "429 Too Many Requests", "TooManyRequests"), Category.RATE_LIMITED, "a source asks for fewer requests"),
    (("SocketTimeoutException", "ConnectTimeoutException", "TimeoutException"), Category.TIMEOUT, "a source didn't answer in time"),
    (("ConnectException", "UnknownHostException", "NoHttpResponseException", "503 Service Unavailable"), Category.TRANSIENT_SOURCE, "a source can't be reached now"),
)


@contextmanager
def sanitised() -> Iterator[None]:
    """Spark's errors quote cell values; these become typed errors without them."""
    from py4j.protocol import Py4JJavaError
    from pyspark.errors import PySparkException

    try:
        yield
    except (PySparkException, Py4JJavaError) as error:
        condition = error.getCondition() if isinstance(error, PySparkException) else None
        text = f"{condition or ''} {error}"
        if found := re.search(r"\[USER_RAISED_EXCEPTION\].*?cleargrain:(\w+):([\w ,.'-]*)", text, re.S):
            category = next((c for c in Category if c.value[0] == found[1]), Category.INTERNAL)
            raise CleaningError(category, found[2].strip()) from None
        for names, category, said in _SPARK:
            if any(n in text for n in names):
                raise CleaningError(category, said) from None
        raise CleaningError(Category.INTERNAL, condition or type(error).__name__) from None


def raised(category: Category, message: str):
    """A column that fails the run where it is evaluated."""
    from pyspark.sql import functions as F

    return F.raise_error(F.lit(f"cleargrain:{category.value[0]}:{message}"))
