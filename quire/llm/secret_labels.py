"""The labelled table that the secret scanner learns from when none is given.

Rows are (before, value, after, kind, secret): a string, what stands around it, and whether it is a
credential. Values have the published shapes of credentials; the ordinary ones include the strings that
look most like them: digests, commit ids, UUIDs, checksums in base64 and words after the same names.
"""

from __future__ import annotations

import random
from collections.abc import Callable

Row = tuple[str, str, str, str, bool]

LOWER, UPPER, DIGITS, HEX = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", "0123456789abcdef"
ALNUM = LOWER + UPPER + DIGITS
NAMES = "token secret password passwd pwd key api_key api-key apikey apiKey access_token auth_token authToken secret_key client_secret private_token access_key private_key credential credentials pass passphrase auth".split()
DIGEST_NAMES = "commit sha sha1 sha256 sha512 md5 checksum revision rev digest etag hash integrity blob tree parent build fingerprint id".split()
SCHEMES = "https http postgres postgresql mysql mongodb redis amqp ftp ssh smtp".split()
#: Between a name and its value, and after the value.
ASSIGNED = [("=", ""), ("=", "\n"), ("=", " "), ("=", "&"), ("=", ";"), (" = ", "\n"), (": ", "\n"), (": ", " "), (": ", "."), (": ", ","), (":", ""), ('="', '"'), (' = "', '"'), (" = '", "'"), ("='", "'"), ('": "', '"'), ("': '", "'"), (" => ", ","), (" := ", "\n")]
LENGTHS = (32, 40, 40, 56, 64, 96, 128)


def labelled_credentials(n: int = 200, seed: int = 3) -> list[Row]:
    """``n`` rows of each kind."""
    r = random.Random(seed)

    def any_of(s: str, k: int) -> str:
        return "".join(r.choice(s) for _ in range(k))

    def word() -> str:
        return any_of(LOWER, r.randint(2, 12))

    def neutral() -> tuple[str, str]:
        before = r.choice((" ", " ", " ", " ", f"{word()} ", f"{word()} {word()} ", f"{word()} {word()} ", f"{word()}, ", f"{word()}. ", "", "(", f"{word()} (", f'{word()} "', f"{word()}: ", f"{word()}\n", f"{word()}=", f"/{word()}/", f"{word()}.", f"{word()}-", f"{word()}_", f"{word()}+", f"{word()}?{word()}="))
        return before, r.choice((" ", " ", " ", " ", ".", ".", ",", "", "\n", ")", '"', ":", ";", "/", "-", "_", "+", "&", "?", "!"))

    def named(names: list[str]) -> tuple[str, str]:
        name = r.choice(names)
        name = r.choice((name, name, name, name.upper(), name.capitalize(), f"{word()}_{name}", f"{word()}.{name}", f"{word().upper()}_{name.upper()}"))
        sep, after = r.choice(ASSIGNED)
        return r.choice(("", f"{word()} ", f"{word()}\n", f"?{word()}=1&", "{'", '{"')) + name + sep, after

    def assigned() -> tuple[str, str]:
        return r.choice((lambda: named(NAMES), lambda: named(NAMES), lambda: named(NAMES), lambda: (r.choice(("Authorization: Bearer ", "authorization: token ", "Bearer ")), r.choice(("\n", '"', ""))), lambda: (f"https://{word()}.{word()}/{word()}?{r.choice(('key', 'api_key', 'token', 'access_token'))}=", r.choice(("&", "", " ", '"')))))()

    def either() -> tuple[str, str]:
        return neutral() if r.random() < 0.6 else assigned()

    def mostly(names: list[str], share: float) -> Callable[[], tuple[str, str]]:
        return lambda: named(names) if r.random() < share else of_a_name() if r.random() < 0.25 else neutral()

    def spoken() -> tuple[str, str]:
        """Words that follow the names of credentials in prose."""
        if r.random() < 0.8:
            return neutral()
        return f"{r.choice(('the', 'a', 'your', 'its', word()))} {r.choice(NAMES)}{r.choice((' ', ' ', ', ', '. ', ': ', ' is ', ' of '))}", r.choice((" ", ".", ",", "\n"))

    def checksummed() -> tuple[str, str]:
        if r.random() < 0.5:
            return neutral()
        return r.choice(("sha256-", "sha384-", "sha512-", "base64,", "checksum: ", "integrity: ")), r.choice(('"', "", " "))

    def setting() -> str:
        return r.choice((word, lambda: any_of(ALNUM, r.randint(1, 3)), lambda: any_of(DIGITS, r.randint(1, 8)), lambda: any_of(HEX, r.randint(1, 12)), lambda: any_of(ALNUM, r.randint(4, 16)), lambda: word()[:6] + any_of(DIGITS, 2), lambda: word().capitalize()))()

    def in_url() -> tuple[str, str]:
        before = r.choice(("", "", f"{word()}.", f"{word()}.", f"{word()}.{word()}/", f"{word()}/", f"{word()}:", f"{word()}-", f"{word()}.{word()}?"))
        return f"{r.choice(SCHEMES)}://{before}", r.choice((":", "/", "/", ".", ".", "?", "=", "-", " ", "", '"')) if before else r.choice((":", "@", "/", ".", "-", " "))

    def of_a_name() -> tuple[str, str]:
        return named([word(), word(), word()[:1], any_of(LOWER, 1) + any_of(DIGITS, 1)])

    def password() -> str:
        s = any_of(ALNUM + LOWER + DIGITS, r.randint(7, 24))
        if r.random() < 0.3:
            return word()[:8].capitalize() + any_of(DIGITS, r.randint(2, 4)) + word()[:5]
        return s[:-2] + any_of("!$#%*-_", 1) + s[-2:] if r.random() < 0.25 else s

    credentials: dict[str, tuple[Callable[[], str], Callable[[], tuple[str, str]]]] = {
        "hex_token": (lambda: any_of(HEX, r.choice(LENGTHS)), assigned),
        "upper_hex_token": (lambda: any_of(HEX.upper(), r.choice(LENGTHS)), assigned),
        "access_key_id": (lambda: r.choice(("AKIA", "ASIA")) + any_of(UPPER + DIGITS, 16), either),
        "secret_access_key": (lambda: any_of(ALNUM + "+/", 38).strip("+/").ljust(40, r.choice(ALNUM)), lambda: named(["aws_secret_access_key", "secret_access_key", "SecretAccessKey", "secret_key", "AWS_SECRET_ACCESS_KEY"])),
        "forge_token": (lambda: r.choice(("ghp_", "gho_", "ghs_", "ghu_")) + any_of(ALNUM, 36), either),
        "forge_fine_token": (lambda: "github_pat_" + any_of(ALNUM, 22) + "_" + any_of(ALNUM, 59), either),
        "lab_token": (lambda: "glpat-" + any_of(ALNUM, 20), either),
        "registry_token": (lambda: "npm_" + any_of(ALNUM, 36), either),
        "payment_key": (lambda: r.choice(("sk_", "rk_")) + r.choice(("live_", "test_")) + any_of(ALNUM, 24), either),
        "model_key": (lambda: "sk-" + r.choice(("proj-", "ant-", "")) + any_of(ALNUM, r.randint(40, 60)), either),
        "mail_key": (lambda: "SG." + any_of(ALNUM, 22) + "." + any_of(ALNUM, 43), either),
        "chat_token": (lambda: "xox" + r.choice("bpa") + f"-{any_of(DIGITS, 12)}-{any_of(DIGITS, 12)}-" + any_of(ALNUM, 24), either),
        "map_key": (lambda: "AIza" + any_of(ALNUM + "_-", 34) + r.choice(ALNUM), either),
        "web_token": (lambda: "eyJ" + any_of(ALNUM, r.randint(20, 60)) + ".eyJ" + any_of(ALNUM * 4 + "_-", r.randint(30, 90)) + "." + any_of(ALNUM * 4 + "_-", 42) + r.choice(ALNUM), either),
        "password": (password, lambda: named(["password", "passwd", "pwd", "pass", "secret", "db_password", "PASSWORD", "passphrase"])),
        "hex_password": (lambda: any_of(HEX, r.randint(8, 31)), lambda: named(["password", "passwd", "pwd", "pass", "secret", "token", "db_password", "passphrase"])),
        "url_password": (password, lambda: (f"{r.choice(SCHEMES)}://{word()}:", "@")),
        "private_key": (lambda: "MII" + any_of(ALNUM * 8 + "+/", r.randint(120, 200)) + r.choice(("", "=", "==")), lambda: (f"-----BEGIN {r.choice(('', 'RSA ', 'EC ', 'OPENSSH ', 'ENCRYPTED '))}PRIVATE KEY-----\n", "\n")),
    }
    ordinary: dict[str, tuple[Callable[[], str], Callable[[], tuple[str, str]]]] = {
        "word": (word, spoken),
        "long_word": (lambda: any_of(LOWER, r.randint(12, 40)), spoken),
        "capital_word": (lambda: any_of(UPPER, 1) + any_of(LOWER, r.randint(1, 20)), spoken),
        "capitals": (lambda: any_of(UPPER, r.randint(1, 30)), spoken),
        "camel_word": (lambda: "".join(w.capitalize() for w in (word(), word(), word())), spoken),
        "hyphenated": (lambda: "-".join(word() for _ in range(r.randint(2, 6))), spoken),
        "snake_word": (lambda: "_".join(word() for _ in range(r.randint(2, 6))), spoken),
        "path": (lambda: "/".join(word() for _ in range(r.randint(2, 6))) + r.choice(("", ".html", ".txt")), neutral),
        "host": (lambda: f"{word()}{r.choice(('', str(r.randint(0, 99))))}.{word()}.{r.choice(('com', 'org', 'net'))}", mostly(["host", "url", "server"], 0.2)),
        "number": (lambda: any_of(DIGITS, r.randint(1, 20)), mostly(["id", "count", "total", "port", "year", "key", "pass"], 0.2)),
        "port": (lambda: any_of(DIGITS, r.randint(2, 5)), lambda: (f"{r.choice(('', f'{word()}@', f'{word()}:{word()}@'))}{word()}.{r.choice((word(), 'host', 'com', 'local'))}:", r.choice(("/", "/", "", " ", '"')))),
        "number_groups": (lambda: r.choice("-./_").join(any_of(DIGITS, r.randint(1, 4)) for _ in range(r.randint(2, 5))), neutral),
        "dated": (lambda: f"20{any_of('012', 2)}-0{r.randint(1, 9)}-{r.randint(10, 28)}-{word()}-{word()}", neutral),
        "numbered_word": (lambda: word() + any_of(DIGITS, r.randint(1, 4)) + r.choice(("", word())), spoken),
        "code": (lambda: any_of(UPPER, r.randint(1, 4)) + r.choice(("", "-")) + any_of(DIGITS, r.randint(1, 6)) + r.choice(("", any_of(UPPER, 2))), mostly(["id", "part", "model", "order"], 0.2)),
        "digest": (lambda: any_of(HEX, r.choice(LENGTHS)), mostly(DIGEST_NAMES, 0.5)),
        "upper_digest": (lambda: any_of(HEX.upper(), r.choice(LENGTHS)), mostly(DIGEST_NAMES, 0.5)),
        "short_digest": (lambda: any_of(HEX, r.randint(6, 16)), mostly(DIGEST_NAMES, 0.5)),
        "spoken_digest": (lambda: any_of(HEX, r.choice(LENGTHS)), lambda: (f"{r.choice(('', word() + ' '))}{r.choice(DIGEST_NAMES)}{r.choice((' ', ':', ': ', '-', '/'))}", r.choice((" ", ".", ",", "\n", "", ")")))),
        "uuid": (lambda: any_of(HEX, 8) + "-" + "-".join(any_of(HEX, 4) for _ in range(3)) + "-" + any_of(HEX, 12), mostly(["id", "uuid", "guid", "request", "trace"], 0.4)),
        "base64_checksum": (lambda: any_of(ALNUM * 8 + "+/", r.choice((27, 43, 64, 86))).strip("+/") + r.choice(("", "=", "==")), checksummed),
        "certificate": (lambda: "MII" + any_of(ALNUM * 8 + "+/", r.randint(120, 200)) + r.choice(("", "=", "==")), lambda: (f"-----BEGIN {r.choice(('CERTIFICATE', 'PUBLIC KEY', 'RSA PUBLIC KEY', 'CERTIFICATE REQUEST'))}-----\n", "\n")),
        "mail_name": (lambda: word() + r.choice(("", ".")) + r.choice((word(), any_of(DIGITS, 2))), lambda: (r.choice((" ", f"{word()} ", "<", f"{word()}.", "mailto:", "(")), "@")),
        "setting": (setting, of_a_name),
        "opaque_parts": (lambda: r.choice("-/._").join([r.choice((word(), "sha256", "sha512", "sha384", any_of(ALNUM, 20))), *(any_of(ALNUM, r.randint(12, 200)) for _ in range(r.randint(1, 3)))]), lambda: r.choice((neutral, of_a_name))()),
        "opaque": (lambda: any_of(ALNUM, r.randint(12, 300)), lambda: r.choice((neutral, of_a_name, checksummed))()),
        "url_part": (lambda: r.choice((word, word, word, lambda: any_of(DIGITS, r.randint(2, 5))))(), in_url),
    }
    rows = [(*f(), kind) for kind, (v, c) in credentials.items() for f in [lambda v=v, c=c: (c(), v())] * n]
    made = [(around[0], value, around[1], kind, True) for around, value, kind in rows]
    rows = [(*f(), kind) for kind, (v, c) in ordinary.items() for f in [lambda v=v, c=c: (c(), v())] * n]
    return made + [(around[0], value, around[1], kind, False) for around, value, kind in rows]
