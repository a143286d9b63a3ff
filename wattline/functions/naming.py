"""Register names: wide column names, spreadsheet headers, display names."""

import re

from pyspark.sql import functions as F


def column_name(register):
    """Wide column of a register: no unit, lower case, ``Grid vac1(V)`` becomes ``grid_vac1``."""
    bare = re.sub(r"\([^()]*\)$", "", register)
    return bare.strip().replace(" ", "_").lower()


def clean_header(header):
    """Spreadsheet header without its trailing ``/ddd`` or ``/ddd-ddd``, with a plain C for ℃."""
    name = F.regexp_replace(header, r"/[0-9]{3}$", "")
    name = F.regexp_replace(name, r"/[0-9]{3}-[0-9]{3}$", "")
    return F.replace(name, F.lit("℃"), F.lit("C"))


def clean_name(header):
    """The same for a header that is known when the query is written."""
    name = re.sub(r"/[0-9]{3}-[0-9]{3}$", "", re.sub(r"/[0-9]{3}$", "", header))
    return name.replace("℃", "C")


def display_name(register, friendly, unit, friendly_name=False, add_unit=False):
    """The raw name, or the friendly one where there is one, with its unit on request."""
    if not friendly_name:
        return register
    name = F.coalesce(friendly, register)
    if not add_unit:
        return name
    return F.when(unit != "", F.concat(name, F.lit(" ("), unit, F.lit(")"))).otherwise(name)
