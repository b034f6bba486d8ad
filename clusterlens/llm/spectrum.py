"""Eigenvalues and eigenvectors of a symmetric integer matrix with no negative
eigenvalue, from its exact characteristic polynomial.

The polynomial is found modulo many primes (Hessenberg reduction) and put
together by Chinese remaindering. All its roots are real, so Descartes' rule of signs is
exact: the sign changes of p(x + a) count the roots above a. Bisection on that
count isolates a root, bisection on exact signs refines it to as many bits as
wanted, and inverse iteration in fixed point finds its null space.

Everything here works on one d x d matrix, bounded by the dimension and not by
the rows behind it; primes and roots are independent of each other.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from fractions import Fraction

import numpy as np

Poly = list[int]  # coefficients from the constant up


def primes() -> Iterator[int]:
    """Primes below 2**31, the largest first (products of two residues fit 62 bits)."""
    for n in range((1 << 31) - 1, 1 << 30, -2):
        if all(n % small for small in (3, 5, 7, 11, 13)) and all(_strong(n, base) for base in (2, 3, 5, 7)):
            yield n


def _strong(n: int, base: int) -> bool:
    """Whether odd n < 3.2e9 passes the strong test to a base."""
    odd, twos = n - 1, 0
    while odd % 2 == 0:
        odd, twos = odd // 2, twos + 1
    x = pow(base, odd, n)
    return x in (1, n - 1) or any((x := x * x % n) == n - 1 for _ in range(twos - 1))


def coefficient_bits(trace: int, d: int) -> int:
    """Bits that hold every coefficient: the k-th elementary symmetric function of d
    eigenvalues that add up to the trace is at most C(d, k) (trace / d)^k."""
    if not trace:
        return 2
    log = math.log2(trace) - math.log2(d)
    return 3 + math.ceil(max(math.log2(math.comb(d, k)) + k * log for k in range(d + 1)))


def enough_primes(bits: int) -> list[int]:
    """Primes whose product exceeds 2**bits (one bit more holds the sign)."""
    out, product = [], 1
    for p in primes():
        out.append(p)
        product *= p
        if product.bit_length() > bits + 1:
            return out
    raise ValueError("the matrix is too large")


def polynomial_mod(matrix: np.ndarray, p: int) -> np.ndarray:
    """Characteristic polynomial (monic, constant first) of a matrix of residues mod p."""
    h = matrix.astype(np.int64) % p
    d = len(h)
    for m in range(1, d - 1):
        below = np.flatnonzero(h[m:, m - 1])
        if not len(below):
            continue
        i = m + int(below[0])
        if i != m:
            h[[m, i]] = h[[i, m]]
            h[:, [m, i]] = h[:, [i, m]]
        u = h[m + 1:, m - 1] * pow(int(h[m, m - 1]), -1, p) % p
        h[m + 1:] = (h[m + 1:] - u[:, None] * h[m] % p) % p
        h[:, m] = (h[:, m] + (h[:, m + 1:] * u % p).sum(1)) % p
    polys = np.zeros((d + 1, d + 1), np.int64)
    polys[0, 0] = 1
    for k in range(1, d + 1):
        polys[k, 1:] = polys[k - 1, :-1]
        below, weights = 1, np.zeros(k, np.int64)  # of the polynomials of smaller blocks
        for i in range(k - 1, -1, -1):
            weights[i] = int(h[i, k - 1]) * below % p
            below = below * int(h[i, i - 1]) % p if i else 0
        polys[k] = (polys[k] - (weights[:, None] * polys[:k] % p).sum(0)) % p
    return polys[d]


def remaindered(residues: Sequence[tuple[int, Sequence[int]]]) -> Poly:
    """The polynomial with coefficients nearest to 0 that has these (prime, residues)."""
    product, out = 1, [0] * len(residues[0][1])
    for p, values in residues:
        inverse = pow(product, -1, p)
        out = [x + product * ((int(v) - x) * inverse % p) for x, v in zip(out, values, strict=True)]
        product *= p
    return [x - product if 2 * x > product else x for x in out]


def _monic_mod(a: list[int], p: int) -> list[int]:
    while a and a[-1] % p == 0:
        a = a[:-1]
    if not a:
        return []
    inverse = pow(a[-1], -1, p)
    return [x * inverse % p for x in a]


def _gcd_mod(a: Poly, b: Poly, p: int) -> list[int]:
    a, b = _monic_mod(list(a), p), _monic_mod(list(b), p)
    while b:
        while len(a) >= len(b):
            lead, shift = a[-1], len(a) - len(b)
            a = [(x - lead * b[i - shift]) % p if i >= shift else x for i, x in enumerate(a)][:-1]
            while a and not a[-1]:
                a.pop()
        a, b = b, _monic_mod(a, p)
    return a


def square_free(poly: Poly) -> Poly:
    """The monic polynomial with the same roots, each of them once."""
    d = len(poly) - 1
    slope = [i * c for i, c in enumerate(poly)][1:]
    bound = d + 2 + sum(c * c for c in poly).bit_length() // 2 + 1
    images, product = [], 1
    for p in primes():
        g = _gcd_mod(poly, slope, p)
        if len(g) == 1:
            return poly
        if images and len(g) > len(images[0][1]):
            continue  # an unlucky prime
        if images and len(g) < len(images[0][1]):
            images, product = [], 1
        images.append((p, g))
        product *= p
        if product.bit_length() > bound + 1:
            return _divided(poly, remaindered(images))
    raise ValueError("the polynomial is too large")


def _divided(a: Poly, b: Poly) -> Poly:
    """Exact quotient of two monic polynomials."""
    a, out = list(a), [0] * (len(a) - len(b) + 1)
    for i in reversed(range(len(out))):
        out[i] = a[i + len(b) - 1]
        for j, x in enumerate(b):
            a[i + j] -= out[i] * x
    return out


def _scaled(poly: Poly, bits: int) -> Poly:
    """The polynomial whose roots are 2**bits times as large."""
    d = len(poly) - 1
    return [c << (bits * (d - i)) for i, c in enumerate(poly)]


def roots_above(poly: Poly, a: int) -> int:
    """How many roots, each as often as it counts, lie above ``a``; all must be real."""
    c = list(poly)
    for i in range(len(c) - 1):
        for j in range(len(c) - 2, i - 1, -1):
            c[j] += a * c[j + 1]
    signs = [x > 0 for x in c if x]
    return sum(x != y for x, y in zip(signs, signs[1:], strict=False))


def isolate(poly: Poly, free: Poly, k: int) -> tuple[int, int, int, int, int]:
    """(low, high, bits, first, count): the k-th largest root (from 1) of ``poly`` is the only
    root of ``free`` in (low, high] / 2**bits and stands at first .. first + count - 1."""
    low, high, bits = 0, 1, 0
    while roots_above(free, high):
        high *= 2
    while True:
        f, p = _scaled(free, bits), _scaled(poly, bits)
        while high - low > 1:
            if roots_above(f, low) - roots_above(f, high) == 1:
                above = roots_above(p, high)
                return low, high, bits, above + 1, roots_above(p, low) - above
            middle = (low + high) // 2
            low, high = (middle, high) if roots_above(p, middle) >= k else (low, middle)
        low, high, bits = low << 16, high << 16, bits + 16


def refine(free: Poly, low: int, high: int, bits: int, target: int) -> int:
    """floor or ceiling of the root in (low, high] / 2**bits, times 2**target."""
    more = max(target - bits, 0)
    low, high, f = low << more, high << more, _scaled(free, bits + more)

    def value(x: int) -> int:
        out = 0
        for c in reversed(f):
            out = out * x + c
        return out

    at_high = value(high)
    if not at_high:
        return high
    while high - low > 1:
        middle = (low + high) // 2
        v = value(middle)
        if not v:
            return middle
        low, high = (low, middle) if (v > 0) == (at_high > 0) else (middle, high)
    return high


def null_space(matrix: list[list[int]], root: int, bits: int, count: int) -> np.ndarray | None:
    """``count`` orthonormal vectors, scaled by 2**bits, of the null space of matrix - root / 2**bits.

    None if the iteration doesn't settle at this precision.
    """
    d, one = len(matrix), 1 << bits
    a = np.array([[x << bits for x in row] for row in matrix], object)
    a[range(d), range(d)] -= root
    order = list(range(d))
    for k in range(d):
        best = k + int(np.argmax(np.abs(a[k:, k])))
        if best != k:
            a[[k, best]] = a[[best, k]]
            order[k], order[best] = order[best], order[k]
        if not a[k, k]:
            a[k, k] = 1
        if k + 1 < d:
            factors = np.array([(x << bits) // a[k, k] for x in a[k + 1:, k]], object)
            a[k + 1:, k] = factors
            a[k + 1:, k + 1:] -= (factors[:, None] * a[k, k + 1:]) >> bits

    def solved(b: np.ndarray) -> np.ndarray:
        x = b[order].copy()
        for k in range(d):
            x[k + 1:] -= (a[k + 1:, k] * x[k]) >> bits
        for k in reversed(range(d)):
            x[k] = (x[k] << bits) // a[k, k]
            x[:k] -= (a[:k, k] * x[k]) >> bits
        return x

    def unit(x: np.ndarray, others: list[np.ndarray]) -> np.ndarray:
        for _ in range(2):
            shift = max(int(np.max(np.abs(x))).bit_length() - bits, 0)
            x = x >> shift
            for o in others:
                x = x - ((o * (int((x * o).sum()) >> bits)) >> bits)
        length = math.isqrt(int((x * x).sum()))
        return np.array([(v << bits) // length for v in x], object)

    found: list[np.ndarray] = []
    rng = np.random.default_rng(11)
    for _ in range(count):
        x = unit(np.array([int(v) << (bits - 30) for v in rng.integers(1, 1 << 30, d)], object), found)
        for turn in range(6):
            before, x = x, unit(solved(x), found)
            if int(np.max(np.abs(np.minimum(np.abs(x - before), np.abs(x + before))))) < one >> 64:
                break
        else:
            return None
        found.append(x)
    return np.array(found, object)


def components(matrix: list[list[int]], poly: Poly, free: Poly, k: int) -> list[tuple[int, Fraction, list[float]]]:
    """(component, eigenvalue, unit vector) of the eigenspace that begins at the k-th
    largest eigenvalue; nothing if the k-th one belongs to one that begins before.

    Of the two signs of a vector, the one whose largest entry is positive.
    """
    low, high, bits, first, count = isolate(poly, free, k)
    if first != k:
        return []
    precision = 160
    while True:
        root = refine(free, low, high, bits, precision)
        exact = max(precision, bits)
        vectors = null_space(matrix, root, exact, count)
        if vectors is not None:
            break
        precision *= 2
    out = []
    for i, v in enumerate(vectors):
        sign = 1 if v[int(np.argmax(np.abs(v)))] > 0 else -1
        out.append((k + i, Fraction(root, 1 << exact), [sign * int(x) / (1 << exact) for x in v]))
    return out
