"""Repository addresses and failure messages as column expressions."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..errors import EngineError

OWNER = r"[A-Za-z0-9](?:[A-Za-z0-9-]{0,37}[A-Za-z0-9])?"
ADDRESS = rf"^github\.com/({OWNER})/([A-Za-z0-9._-]{{1,100}})$"


def normal_address(url: Column) -> Column:
    """Without blanks around it, scheme, www., one final slash and a final .git, in this order."""
    bare = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.regexp_replace(url, r"^\s+|\s+$", ""), "^https://", ""), "^http://", ""), r"^www\.", "")
    return F.regexp_replace(F.regexp_replace(bare, "/$", ""), r"\.git$", "")


def parse_address(url: Column) -> Column:
    """struct(owner, name), null where the address is none."""
    bare = normal_address(url)
    name = F.regexp_extract(bare, ADDRESS, 2)
    return F.when(bare.rlike(ADDRESS) & ~name.isin(".", ".."), F.struct(F.regexp_extract(bare, ADDRESS, 1).alias("owner"), name.alias("name")))


def check_reference(owner: str, name: str) -> tuple[str, str]:
    if not re.fullmatch(OWNER, owner) or not re.fullmatch(r"[A-Za-z0-9._-]{1,100}", name) or name in (".", ".."):
        raise EngineError("not a repository address")
    return owner, name


def clone_failure_status(message: Column) -> Column:
    low = F.lower(message)
    has = lambda *words: reduce(lambda a, b: a | b, [F.contains(low, F.lit(w)) for w in words])
    return (
        F.when(has("could not resolve host", "failed to connect"), 502)
        .when(has("authentication failed", "could not read username"), 403)
        .when(has("not found", "repository does not exist"), 404)
        .otherwise(502)
    )


def retriable(message: Column) -> Column:
    return message.rlike("503|UNAVAILABLE|429|RESOURCE_EXHAUSTED")


def service_failure_status(message: Column) -> Column:
    return F.when(message.rlike("429|RESOURCE_EXHAUSTED"), 429).when(message.rlike("503|UNAVAILABLE"), 503).otherwise(502)


_RETRIABLE = re.compile("503|UNAVAILABLE|429|RESOURCE_EXHAUSTED")
# what each kind of failure of a service means, the first that its text holds
_FAILURES = [("429|RESOURCE_EXHAUSTED", "over the request limit; wait a minute and ask again", 429), ("503|UNAVAILABLE", "the model is busy; try again in a few seconds", 503), ("404|NOT_FOUND", "there is no model of that name; check the settings", 502), ("401|403|PERMISSION", "the key was refused; check the settings", 502)]


def is_retriable(message: str) -> bool:
    return bool(_RETRIABLE.search(message))


def failure(message: str) -> tuple[str, int]:
    """(text for the user, status) of a service's failure."""
    return next(((text, status) for pattern, text, status in _FAILURES if re.search(pattern, message)), ("no answer was made; try again later", 502))


def service_failure_message(message: Column) -> Column:
    out = F.lit("no answer was made; try again later")
    for pattern, text, _ in reversed(_FAILURES):
        out = F.when(message.rlike(pattern), text).otherwise(out)
    return out


def clone_failure_message(message: Column) -> Column:
    """What a failed clone means, by its status."""
    status = clone_failure_status(message)
    return F.when(status == 403, "the repository is private or its address needs a login").when(status == 404, "there is no such repository").when(F.lower(message).rlike("could not resolve host|failed to connect"), "the host cannot be reached").otherwise("the repository could not be cloned")


def clone_failure(message: str) -> tuple[str, int]:
    """(text for the user, status) of a failed clone's output."""
    low = message.lower()
    if "could not resolve host" in low or "failed to connect" in low:
        return "the host cannot be reached", 502
    if "authentication failed" in low or "could not read username" in low:
        return "the repository is private or its address needs a login", 403
    if "not found" in low or "repository does not exist" in low:
        return "there is no such repository", 404
    return "the repository could not be cloned", 502
