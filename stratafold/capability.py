"""Capability tokens: signed grants of abilities on spaces, delegated in chains.

A token says who issued it, to whom, which abilities on which spaces, from when and until when, and which token it derives from. Names are
hashes of secret keys and signatures are HMACs, since no public-key library is at hand: a verifier must know the issuer's key.
"""

from __future__ import annotations

import base64
import hashlib
import hmac
import json
import re
import secrets
import time
from collections import OrderedDict
from dataclasses import dataclass

from .errors import AccessDenied, InvalidStatement

SKEW, LONGEST_CHAIN = 60, 8
#: Requests that a gate remembers.
REMEMBERED = 200_000
DEFAULT_SECONDS, MOST_SECONDS = 24 * 3600, 366 * 24 * 3600
_UNITS = {"s": 1, "sec": 1, "secs": 1, "second": 1, "seconds": 1, "m": 60, "min": 60, "mins": 60, "minute": 60, "minutes": 60, "h": 3600, "hour": 3600, "hours": 3600, "d": 86400, "day": 86400, "days": 86400}
ABILITIES = ("space/query", "space/read", "space/*")


def duration(text: str) -> int:
    """Seconds of `30`, `15m`, `2 hours` and the like; from one second to 366 days."""
    m = re.fullmatch(r"\s*(\d+)\s*([a-zA-Z]*)\s*", text)
    if not m or (m[2] and m[2].lower() not in _UNITS):
        raise InvalidStatement(f"invalid duration '{text}'")
    seconds = int(m[1]) * _UNITS.get(m[2].lower(), 1)
    if not 1 <= seconds <= MOST_SECONDS:
        raise InvalidStatement(f"duration '{text}' is not between 1 second and 366 days")
    return seconds


def covers(held: tuple[str, str], wanted: tuple[str, str]) -> bool:
    """Whether an ability on a resource includes another: the same or a whole group of them, on the same space or on all."""
    (have, on), (want, at) = held, wanted
    resource = on == at or on == "*" or (on.endswith("/*") and at.startswith(on[:-1]))
    ability = have == want or have == "space/*" or (have.endswith("/*") and want.startswith(have[:-1])) or (have == "space/read" and want == "space/query")
    return resource and ability


def did(key: bytes) -> str:
    return "did:key:h" + base64.b32encode(hashlib.sha256(key).digest()).decode().lower().rstrip("=")


@dataclass
class Identity:
    key: bytes

    @property
    def did(self) -> str:
        return did(self.key)

    def sign(self, payload: bytes) -> str:
        return hmac.new(self.key, payload, hashlib.sha256).hexdigest()


def issue(identity: Identity, audience: str, capabilities: list[tuple[str, str]], seconds: int = DEFAULT_SECONDS, proof: str | None = None, now: float | None = None) -> str:
    """A token, as text."""
    now = int(now if now is not None else time.time())
    body = {"iss": identity.did, "aud": audience, "cap": capabilities, "nbf": now, "exp": now + seconds, "prf": proof}
    payload = json.dumps(body, sort_keys=True).encode()
    return base64.urlsafe_b64encode(payload).decode() + "." + identity.sign(payload)


def token_id(token: str) -> str:
    return hashlib.sha256(token.encode()).hexdigest()[:32]


def decode(token: str) -> dict:
    try:
        return json.loads(base64.urlsafe_b64decode(token.split(".")[0]))
    except Exception as e:  # noqa: BLE001
        raise AccessDenied("the token cannot be read") from e


def verify(token: str, audience: str, keys: dict[str, bytes], revoked: set[str] = frozenset(), now: float | None = None) -> dict:
    """The claims of a token if it and the tokens it derives from hold; its `root` is who issued the first."""
    now = now if now is not None else time.time()
    claims, child, at, length = decode(token), None, token, 0
    while True:
        length += 1
        body = decode(at)
        payload = base64.urlsafe_b64decode(at.split(".")[0])
        key = keys.get(body["iss"])
        if length > LONGEST_CHAIN:
            raise AccessDenied(f"the chain of tokens is longer than {LONGEST_CHAIN}")
        if key is None or not hmac.compare_digest(Identity(key).sign(payload), at.rpartition(".")[2]):
            raise AccessDenied("the token's signature does not hold")
        if token_id(at) in revoked:
            raise AccessDenied("the token is revoked")
        if body["aud"] != (audience if child is None else child["iss"]):
            raise AccessDenied("the token is for someone else")
        if now > body["exp"] + SKEW or now < body["nbf"] - SKEW:
            raise AccessDenied("the token is not valid now")
        if child is not None:
            if child["exp"] > body["exp"]:
                raise AccessDenied("a token outlives the one it derives from")
            for c in child["cap"]:
                if not any(covers(tuple(p), tuple(c)) for p in body["cap"]):
                    raise AccessDenied("a token grants more than the one it derives from")
        if not body["prf"]:
            return claims | {"root": body["iss"], "first": body["aud"]}
        child, at = body, body["prf"]


# Requests


def sign_request(identity: Identity, method: str, payload: bytes, token: str, now: float | None = None) -> dict[str, str]:
    """What a caller sends beside a request: who it is, its token, when, a number used once, and a signature over all of it and the payload."""
    fields = {"did": identity.did, "token": token, "at": f"{now if now is not None else time.time():.3f}", "once": secrets.token_hex(12)}
    return fields | {"signature": identity.sign(_request(method, payload, fields))}


def _request(method: str, payload: bytes, fields: dict[str, str]) -> bytes:
    return "\n".join([method, hashlib.sha256(payload).hexdigest(), *(fields[k] for k in ("did", "at", "once")), token_id(fields["token"])]).encode()


class Gate:
    """Lets a signed request pass once. It remembers requests for as long as their time would hold, and `most` of them at least."""

    def __init__(self, most: int = REMEMBERED) -> None:
        self.most = most
        self.seen: OrderedDict[tuple[str, str], float] = OrderedDict()

    def check(self, method: str, payload: bytes, fields: dict[str, str], keys: dict[str, bytes], revoked: set[str] = frozenset(), now: float | None = None) -> dict:
        """The claims of the request's token; an error unless the caller signed just this, lately, and for the first time."""
        now = now if now is not None else time.time()
        try:
            key, at, once = keys.get(fields["did"]), float(fields["at"]), (fields["did"], fields["once"])
            signed = key is not None and hmac.compare_digest(Identity(key).sign(_request(method, payload, fields)), fields["signature"])
        except (KeyError, ValueError) as e:
            raise AccessDenied("the request is not signed") from e
        if not signed:
            raise AccessDenied("the request's signature does not hold")
        if not abs(now - at) <= SKEW:
            raise AccessDenied("the request is not of now")
        if once in self.seen:
            raise AccessDenied("the request was made before")
        claims = verify(fields["token"], fields["did"], keys, revoked, now)
        self.seen[once] = at
        while len(self.seen) > self.most and next(iter(self.seen.values())) < now - 2 * SKEW:
            self.seen.popitem(last=False)
        return claims
