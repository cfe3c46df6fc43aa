"""Passwords and signed tokens, for single logins on the driver."""

from __future__ import annotations

import base64
import hashlib
import hmac
import json
import os
import time

LIFE_S = 24 * 3600


def hash_password(password: str) -> str:
    """Salted scrypt, as salt and hash in hex."""
    salt = os.urandom(16)
    return f"{salt.hex()}${hashlib.scrypt(password.encode(), salt=salt, n=2**14, r=8, p=1).hex()}"


def verify_password(password: str, stored: str) -> bool:
    salt, _, want = stored.partition("$")
    return hmac.compare_digest(hashlib.scrypt(password.encode(), salt=bytes.fromhex(salt), n=2**14, r=8, p=1).hex(), want)


def _part(data: bytes) -> str:
    return base64.urlsafe_b64encode(data).rstrip(b"=").decode()


def sign(username: str, roles: list[str], secret: bytes, now: int | None = None) -> str:
    """An HS256 token that ends after a day."""
    now = int(time.time()) if now is None else now
    head = _part(b'{"alg":"HS256","typ":"JWT"}')
    body = _part(json.dumps({"sub": username, "roles": roles, "exp": now + LIFE_S, "iat": now}, separators=(",", ":")).encode())
    return f"{head}.{body}.{_part(hmac.new(secret, f'{head}.{body}'.encode(), hashlib.sha256).digest())}"


def verify(token: str, secret: bytes, now: int | None = None) -> dict:
    """The claims of a valid token; ValueError for others."""
    parts = token.split(".")
    if len(parts) != 3 or not hmac.compare_digest(_part(hmac.new(secret, f"{parts[0]}.{parts[1]}".encode(), hashlib.sha256).digest()), parts[2]):
        raise ValueError("bad signature")
    claims = json.loads(base64.urlsafe_b64decode(parts[1] + "=" * (-len(parts[1]) % 4)))
    if claims["exp"] <= (time.time() if now is None else now):
        raise ValueError("expired")
    return claims
