"""The standard security handler for documents that open with an empty user password."""

from __future__ import annotations

import hashlib

from folia.errors import Encrypted

#: Fixed value of the PDF standard: what fills a password up to 32 bytes.
PADDING = bytes.fromhex("28BF4E5E4E758A4164004E56FFFA01082E2E00B6D0683E802F0CA9FE6453697A")


def rc4(key: bytes, data: bytes) -> bytes:
    state, j = list(range(256)), 0
    for i in range(256):
        j = (j + state[i] + key[i % len(key)]) & 255
        state[i], state[j] = state[j], state[i]
    out, i, j = bytearray(len(data)), 0, 0
    for k, c in enumerate(data):
        i = (i + 1) & 255
        x = state[i]
        j = (j + x) & 255
        y = state[j]
        state[i], state[j] = y, x
        out[k] = c ^ state[(x + y) & 255]
    return bytes(out)


def _boxes() -> tuple[list[int], list[int]]:
    """The substitution box and its inverse, from inversion in the field of 256 elements and the affine map."""
    box, p, q = [0] * 256, 1, 1
    while True:
        p ^= ((p << 1) & 255) ^ (0x1B if p & 128 else 0)
        for shift in (1, 2, 4):
            q ^= (q << shift) & 255
        q ^= 9 if q & 128 else 0
        box[p] = (q ^ ((q << 1 | q >> 7) & 255) ^ ((q << 2 | q >> 6) & 255) ^ ((q << 3 | q >> 5) & 255) ^ ((q << 4 | q >> 4) & 255)) ^ 0x63
        if p == 1:
            break
    box[0] = 0x63
    back = [0] * 256
    for a, b in enumerate(box):
        back[b] = a
    return box, back


_BOX, _BACK = _boxes()


def _times(x: int, y: int) -> int:
    out = 0
    while y:
        out ^= x if y & 1 else 0
        x = ((x << 1) & 255) ^ (0x1B if x & 128 else 0)
        y >>= 1
    return out


def _columns(box: list[int], factors: tuple[int, ...]) -> list[list[int]]:
    """For each row, the 32-bit column that a byte adds to after substitution."""
    return [[int.from_bytes(bytes(_times(box[x], factors[(k - row) % 4]) for k in range(4)), "big") for x in range(256)] for row in range(4)]


_FORTH = _columns(_BOX, (2, 1, 1, 3))
_MIX = _columns(list(range(256)), (14, 9, 13, 11))
_BACKMIX = _columns(_BACK, (14, 9, 13, 11))


class Aes:
    """AES on blocks, with a word-wise table for each row."""

    def __init__(self, key: bytes):
        n = len(key) // 4
        words = [int.from_bytes(key[4 * i : 4 * i + 4], "big") for i in range(n)]
        mark = 1
        for i in range(n, 4 * (n + 7)):
            w = words[-1]
            if i % n == 0:
                w = ((w << 8) | (w >> 24)) & 0xFFFFFFFF
            if i % n == 0 or (n > 6 and i % n == 4):
                w = int.from_bytes(bytes(_BOX[b] for b in w.to_bytes(4, "big")), "big")
            if i % n == 0:
                w ^= mark << 24
                mark = _times(mark, 2)
            words.append(words[i - n] ^ w)
        self.rounds = [words[i : i + 4] for i in range(0, len(words), 4)]
        mix = lambda w: _MIX[0][w >> 24] ^ _MIX[1][w >> 16 & 255] ^ _MIX[2][w >> 8 & 255] ^ _MIX[3][w & 255]
        self.back = [self.rounds[-1], *[[mix(w) for w in r] for r in self.rounds[-2:0:-1]], self.rounds[0]]

    @staticmethod
    def _run(block: bytes, keys, tables, box, order) -> bytes:
        """One block; decryption is the same walk over the columns in the other order."""
        i0, i1, i2, i3 = order
        words = [int.from_bytes(block[4 * c : 4 * c + 4], "big") for c in range(4)]
        first, last = keys[0], keys[-1]
        a, b, c, d = words[i0] ^ first[i0], words[i1] ^ first[i1], words[i2] ^ first[i2], words[i3] ^ first[i3]
        t, u, v, w = tables
        for key in keys[1:-1]:
            a, b, c, d = (
                t[a >> 24] ^ u[b >> 16 & 255] ^ v[c >> 8 & 255] ^ w[d & 255] ^ key[i0],
                t[b >> 24] ^ u[c >> 16 & 255] ^ v[d >> 8 & 255] ^ w[a & 255] ^ key[i1],
                t[c >> 24] ^ u[d >> 16 & 255] ^ v[a >> 8 & 255] ^ w[b & 255] ^ key[i2],
                t[d >> 24] ^ u[a >> 16 & 255] ^ v[b >> 8 & 255] ^ w[c & 255] ^ key[i3],
            )
        out = [0, 0, 0, 0]
        for i, (p, q, r, s) in zip(order, ((a, b, c, d), (b, c, d, a), (c, d, a, b), (d, a, b, c))):
            out[i] = (box[p >> 24] << 24 | box[q >> 16 & 255] << 16 | box[r >> 8 & 255] << 8 | box[s & 255]) ^ last[i]
        return (out[0] << 96 | out[1] << 64 | out[2] << 32 | out[3]).to_bytes(16, "big")

    def encrypt(self, block: bytes) -> bytes:
        return self._run(block, self.rounds, _FORTH, _BOX, (0, 1, 2, 3))

    def decrypt(self, block: bytes) -> bytes:
        return self._run(block, self.back, _BACKMIX, _BACK, (0, 3, 2, 1))


def _xor(a: bytes, b: bytes) -> bytes:
    return (int.from_bytes(a, "big") ^ int.from_bytes(b, "big")).to_bytes(len(a), "big")


def cbc_encrypt(key: bytes, iv: bytes, data: bytes) -> bytes:
    """Whole blocks, without padding."""
    aes, out = Aes(key), []
    for at in range(0, len(data), 16):
        iv = aes.encrypt(_xor(data[at : at + 16], iv))
        out.append(iv)
    return b"".join(out)


def cbc_decrypt(key: bytes, iv: bytes, data: bytes) -> bytes:
    aes, out = Aes(key), []
    for at in range(0, len(data) - 15, 16):
        block = data[at : at + 16]
        out.append(_xor(aes.decrypt(block), iv))
        iv = block
    return b"".join(out)


def aes_data(key: bytes, data: bytes) -> bytes:
    """AES data of a document: the vector in front, padding at the end. Data without a block is empty."""
    if len(data) <= 16:
        return b""
    plain = cbc_decrypt(key, data[:16], data[16:])
    pad = plain[-1] if plain else 0
    return plain[:-pad] if 1 <= pad <= 16 else plain


def hardened(password: bytes, salt: bytes, more: bytes = b"", revision: int = 6) -> bytes:
    """The password hash of AES-256: SHA-256 in revision 5, at least 64 rounds of AES and SHA-2 in revision 6."""
    k = hashlib.sha256(password + salt + more).digest()
    if revision < 6:
        return k
    done, last = 0, 0
    while done < 64 or last > done - 32:
        e = cbc_encrypt(k[:16], k[16:32], (password + k + more) * 64)
        k = (hashlib.sha256, hashlib.sha384, hashlib.sha512)[sum(e[:16]) % 3](e).digest()
        done, last = done + 1, e[-1]
    return k[:32]


class Security:
    """The file key and the way to decrypt the strings and streams of objects."""

    def __init__(self, encrypt: dict, first_id: bytes, resolve=lambda v: v):
        get = lambda k, d=None: resolve(encrypt.get(k, d))
        if str(get("Filter", "Standard")) != "Standard":
            raise Encrypted(f"unsupported security handler: {get('Filter')}")
        self.v, self.r = int(get("V") or 0), int(get("R") or 0)
        self.bytes = int(get("Length") or 40) // 8
        self.method = "rc4"
        if self.v >= 4:
            filters, chosen = get("CF") or {}, str(get("StmF") or "Identity")
            own = resolve(filters.get(chosen)) if chosen != "Identity" else None
            cfm = str(resolve((own or {}).get("CFM", "None")))
            self.method = {"V2": "rc4", "AESV2": "aesv2", "AESV3": "aesv3"}.get(cfm, "identity")
            if self.method == "aesv2":
                self.bytes = 16
        self.o, self.u = get("O") or b"", get("U") or b""
        self.key = self._key_256(get("UE") or b"") if self.v >= 5 else self._key_128(int(get("P") or 0), first_id, get("EncryptMetadata", True) is not False)

    def _key_128(self, p: int, first_id: bytes, metadata: bool) -> bytes:
        n = self.bytes if self.r >= 3 else 5
        key = hashlib.md5(PADDING + self.o[:32] + (p & 0xFFFFFFFF).to_bytes(4, "little") + first_id + (b"\xff" * 4 if self.r >= 4 and not metadata else b"")).digest()
        for _ in range(50 if self.r >= 3 else 0):
            key = hashlib.md5(key[:n]).digest()
        key = key[:n]
        if self.r >= 3:
            check = rc4(key, hashlib.md5(PADDING + first_id).digest())
            for k in range(1, 20):
                check = rc4(bytes(b ^ k for b in key), check)
            right = check == self.u[:16]
        else:
            right = rc4(key, PADDING) == self.u[:32]
        if not right and any(self.u):
            raise Encrypted("the document needs a password")
        return key

    def _key_256(self, ue: bytes) -> bytes:
        if hardened(b"", self.u[32:40], b"", self.r) != self.u[:32]:
            raise Encrypted("the document needs a password")
        return cbc_decrypt(hardened(b"", self.u[40:48], b"", self.r), bytes(16), ue[:32])

    def decrypt(self, data: bytes, num: int, gen: int) -> bytes:
        if self.method == "identity":
            return data
        if self.method == "aesv3":
            return aes_data(self.key, data)
        salted = self.key + num.to_bytes(4, "little")[:3] + gen.to_bytes(4, "little")[:2] + (b"sAlT" if self.method == "aesv2" else b"")
        key = hashlib.md5(salted).digest()[: min(self.bytes + 5, 16)]
        return aes_data(key, data) if self.method == "aesv2" else rc4(key, data)
