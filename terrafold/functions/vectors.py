"""Vector arithmetic on arrays, always in double."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .binding import let

MIN_NORM = 1e-9  # fixed value: a shorter vector is left as it is
HASH_DIM = 16  # fixed value: bytes of an md5


def dot(a: Column, b: Column, dim: int | None = None) -> Column:
    """Inner product. With a known small ``dim`` the sum is unrolled, which keeps it in generated code."""
    if dim is not None:
        terms = [F.get(a, i).cast("double") * F.get(b, i).cast("double") for i in range(dim)]
        total = terms[0]
        for term in terms[1:]:
            total = total + term
        return total
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda acc, x: acc + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double")))


def l2_normalize(a: Column) -> Column:
    scale = F.when(norm(a) < MIN_NORM, F.lit(1.0)).otherwise(norm(a))
    return F.when(a.isNotNull(), let(scale, lambda n: F.transform(a, lambda x: x.cast("double") / n)))


def cosine(a: Column, b: Column) -> Column:
    scale = norm(a) * norm(b)
    return F.when(scale == 0, F.lit(0.0)).otherwise(F.try_divide(dot(a, b), scale))


def digest_embedding(digest: Column) -> Column:
    """Unit vector from the 16 bytes of an md5, given in hexadecimal digits."""
    places, shifts = F.array(*[F.lit(8 * i + 1) for i in range(HASH_DIM // 4)]), F.array(*[F.lit(s) for s in (24, 16, 8, 0)])

    def four(text, place):
        word = F.conv(text.substr(place, F.lit(8)), 16, 10).cast("long")
        byte = lambda w, s: F.call_function("shiftright", w, s).bitwiseAND(F.lit(255))
        return let(word, lambda w: F.transform(shifts, lambda s: byte(w, s).cast("double") / 255.0 - 0.5))

    raw = let(digest, lambda text: F.flatten(F.transform(places, lambda p: four(text, p))))
    return F.when(digest.isNotNull(), let(raw, l2_normalize))


def hash_embedding(text: Column) -> Column:
    """Unit vector from the 16 md5 bytes of a text.

    The zeros that would pad it to a model's width add nothing to a product
    and are not stored.
    """
    return digest_embedding(F.md5(text))
