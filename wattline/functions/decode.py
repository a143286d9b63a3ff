"""Register words to numbers, as column expressions.

Words are 16-bit integers, low word first. All arithmetic is on LONG or DOUBLE, since ANSI mode
raises on INT overflow. The expressions are kept short: Spark generates one method for a whole
stage, and the JVM leaves methods above 8,000 bytes of bytecode uncompiled, many times slower.
"""

from pyspark.sql import functions as F

# Words per register type, and the register spaces.
WORDS = {"int16": 1, "uint16": 1, "int32": 2, "uint32": 2, "float32": 2, "uint64": 4}
SPACES = ["coil", "discrete", "input", "holding"]

# The register whose reading keeps the leading-digit precision.
PRECISION_DEVICE = 1
PRECISION_ADDRESS = 540

# From here on a DOUBLE is beyond the 64-bit integers.
LONG_END = float(2**63)


def word_count(type_):
    """Number of words a register type takes."""
    count = F.lit(1)
    for name, words in WORDS.items():
        if words > 1:
            count = F.when(type_ == name, words).otherwise(count)
    return count


def words_at(words, offset):
    """Up to four words from ``offset`` on as LONG, NULL beyond the end."""
    return [F.get(words, offset + i).cast("long") for i in range(4)]


def decode_words(type_, words):
    """DOUBLE value of a register's words; 0.0 if there are too few of them."""
    return number(type_, *words_at(words, F.lit(0)))


def number(type_, w0, w1, w2, w3):
    """DOUBLE value of a register from its words; a needed word that is NULL makes it 0.0."""
    low, high = w0 + w1 * 65_536, w2 + w3 * 65_536
    value = (
        F.when(type_ == "uint16", w0.cast("double"))
        .when(type_ == "int16", F.when(w0 >= 32_768, w0 - 65_536).otherwise(w0).cast("double"))
        .when(type_ == "uint32", low.cast("double"))
        .when(type_ == "int32", F.when(w1 >= 32_768, low - F.lit(2**32)).otherwise(low).cast("double"))
        .when(type_ == "float32", float32(w0, w1))
        # Both halves are exact as DOUBLE, so their sum is rounded once, as it should be.
        .when(type_ == "uint64", high.cast("double") * float(2**32) + low.cast("double"))
    )
    return F.coalesce(value, F.lit(0.0))


def float32(low, high):
    """IEEE 754 single precision from its two words."""
    sign = F.when(high >= 32_768, F.lit(-1.0)).otherwise(F.lit(1.0))
    exponent = F.shiftright(high, 7) % 256
    mantissa = ((high % 128) * F.lit(65_536) + low).cast("double")
    return (
        F.when(exponent == 255, F.when(mantissa == 0, sign * F.lit(float("inf"))).otherwise(F.lit(float("nan"))))
        .when(exponent == 0, sign * mantissa * F.pow(F.lit(2.0), F.lit(-149.0)))
        .otherwise(sign * (mantissa + 8_388_608.0) * F.pow(F.lit(2.0), (exponent - 150).cast("double")))
    )


def raw_value(value):
    """The decoded number without its fraction; NULL where no 64-bit integer holds it."""
    return F.when(F.abs(value) < LONG_END, value.cast("bigint"))


def precision_first(value):
    """Leading digit d of the rounded number says how far its remaining digits move right.

    2253 has leading digit 2 and remaining digits 253, hence 2.53. Zero and negatives stay.
    """
    below = F.floor(value)
    whole = below + F.when(value - below >= 0.5, 1).otherwise(0)
    digits = whole.cast("string")
    rest = F.concat(F.lit("0"), F.substring(digits, 2, 20)).cast("double")
    moved = rest * F.pow(F.lit(10.0), -F.left(digits, F.lit(1)).cast("double"))
    return F.when((value >= 0.5) & (value < LONG_END), moved).otherwise(value)


def default_preprocess(device_id, address, value):
    """The built-in rule for registers flagged for preprocessing."""
    special = (device_id == PRECISION_DEVICE) & (address == PRECISION_ADDRESS)
    return F.when(special, precision_first(value)).otherwise(value)


def adjusted_address(address, is_zero):
    """Address on the wire: one less where the device counts from one; 0 has no valid form there."""
    return F.when(is_zero, address).otherwise(F.greatest(address - 1, F.lit(0)))


def has_wire_address(address, is_zero):
    """False for address 0 of a device that counts from one."""
    return is_zero | (address > 0)


def near(a, b, eps=1e-9):
    """True if two values are equal within ``eps``."""
    return F.abs(a - b) < F.lit(eps)
