"""Names, identifiers and the text blocks of MGF and MSP."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Fixed value: the URL namespace of RFC 4122.
URL_NAMESPACE = "6ba7b8119dad11d180b400c04fd430c8"


def decimals(values: pa.Array) -> pa.Array:
    """Doubles as Python prints them: the shortest decimal that reads back the same, as Arrow finds it, brought into Python's form.

    Python writes .0 behind whole numbers, exponents of two digits, and numbers
    from 0.0001 to below 10**16 without an exponent.
    """
    known = np.nan_to_num(values.to_numpy(zero_copy_only=False), nan=0.5, posinf=0.5, neginf=-0.5)  # those are texts of their own
    size = np.abs(known)
    text = values.cast(pa.string())
    odd = pc.match_substring(text, "e").to_numpy(zero_copy_only=False) | (size < 1e-4) & (size > 0)
    whole = ~odd & (known == np.rint(known))
    text = pc.binary_join_element_wise(text, pa.array(["", ".0"]).take(pa.array(whole.astype(np.int8))), "")
    if not odd.any():
        return text
    few = text.filter(pa.array(odd))
    # digits and the exponent of the first, from "0.000012", "1.2e+15" or "12000000000000000"
    sign = pc.replace_substring_regex(few, r"^(-?).*$", r"\1")
    bare = pc.replace_substring_regex(few, "^-", "")
    power = pc.replace_substring_regex(few, r"^[^e]*(e\+?)?", "")
    mantissa = pc.replace_substring_regex(bare, r"e.*$", "")
    leading = pc.binary_length(pc.replace_substring_regex(mantissa, r"^(0\.0*|).*$", r"\1")).to_numpy(zero_copy_only=False)
    digits = pc.replace_substring_regex(pc.replace_substring(mantissa, ".", ""), "^0+", "")
    before = pc.binary_length(pc.replace_substring_regex(mantissa, r"\..*$", "")).to_numpy(zero_copy_only=False)
    given = pc.if_else(pc.equal(power, ""), "0", power).cast(pa.int64()).to_numpy(zero_copy_only=False)
    exponent = np.where(leading > 0, 1 - leading, before - 1) + given
    digits = pc.replace_substring_regex(digits, r"0+$", "")
    # with an exponent
    tail = pc.utf8_slice_codeunits(digits, 1)
    short = pc.binary_join_element_wise(pc.utf8_slice_codeunits(digits, 0, 1), pc.if_else(pc.equal(tail, ""), "", "."), tail, "")
    raised = pa.array(np.abs(exponent)).cast(pa.string())
    raised = pc.utf8_lpad(raised, 2, "0")
    scientific = pc.binary_join_element_wise(short, "e", pa.array(["+", "-"]).take(pa.array((exponent < 0).astype(np.int8))), raised, "")
    told = scientific
    for e in np.unique(exponent[(exponent >= -4) & (exponent <= 15)]).tolist():  # without
        here = pa.array(exponent == e)
        some = digits.filter(here)
        if e < 0:
            plain = pc.binary_join_element_wise("0." + "0" * (-e - 1), some, "")
        else:
            wide = pc.utf8_rpad(some, e + 2, "0")
            plain = pc.binary_join_element_wise(pc.utf8_slice_codeunits(wide, 0, e + 1), pc.utf8_slice_codeunits(wide, e + 1), ".")
        told = pc.replace_with_mask(told, here, plain)
    return pc.replace_with_mask(text, pa.array(odd), pc.binary_join_element_wise(sign, told, ""))


@F.arrow_udf(T.StringType())
def float_text(values: pa.Array) -> pa.Array:
    """The shortest decimal text of doubles as Python prints it, which Spark's cast does not give. Null and NaN give null."""
    known = pc.and_(values.is_valid(), pc.invert(pc.is_nan(values.fill_null(0.0))))
    return pc.if_else(known, decimals(values.fill_null(0.0)), pa.scalar(None, pa.string()))


@F.arrow_udf(T.StringType())
def _peak_text(mz: pa.Array, intensity: pa.Array) -> pa.Array:
    known = pc.and_(mz.is_valid(), intensity.is_valid())
    sizes = [pc.if_else(known, pc.list_value_length(a), 0).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64) for a in (mz, intensity)]
    if not np.array_equal(*sizes):
        raise ValueError("m/z and intensity arrays differ in length")
    values = [decimals(a.filter(known).flatten().fill_null(np.nan)) for a in (mz, intensity)]
    lines = pc.binary_join_element_wise(*values, " ")
    first = pa.array(np.concatenate([[0], np.cumsum(sizes[0])]), pa.int32())
    return pc.binary_join(pa.ListArray.from_arrays(first, lines), "\n")


def peak_text(mz: Column, intensity: Column) -> Column:
    """A line "m/z intensity" per peak; empty if either array is null. Arrays of unlike length are an error."""
    return _peak_text(mz.cast("array<double>"), intensity.cast("array<double>"))


def usi(dataset: Column, file: Column, scan: Column, sequence: Column, charge: Column) -> Column:
    """Universal spectrum identifier; null if any part is."""
    text = [c.cast("string") for c in (dataset, file, scan, sequence, charge)]
    return F.concat(F.lit("mzspec:"), text[0], F.lit(":"), text[1], F.lit(":scan:"), text[2], F.lit(":"), text[3], F.lit("/"), text[4])


def cluster_uuid(name: Column) -> Column:
    """Version 5 UUID of a name under the URL namespace."""
    h = F.sha1(F.concat(F.unhex(F.lit(URL_NAMESPACE)), F.encode(name, "UTF-8")))
    variant = F.substring(F.lit("89ab"), (F.instr(F.lit("0123456789abcdef"), F.substring(h, 17, 1)) - 1) % 4 + 1, F.lit(1))
    return F.concat_ws(
        "-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("5"), F.substring(h, 14, 3)), F.concat(variant, F.substring(h, 18, 3)), F.substring(h, 21, 12)
    )


def library_name(usi: Column) -> Column:
    """SEQUENCE/charge: what follows the last colon."""
    return F.split_part(usi, F.lit(":"), F.lit(-1))


def joined_names(usis: Column) -> Column:
    """library_name() of each of several identifiers joined by semicolons."""
    return F.array_join(F.transform(F.split(usis, ";"), library_name), ";")


def dataset_id(file_name: Column) -> Column:
    """A file's name up to its first hyphen."""
    return F.split_part(file_name, F.lit("-"), F.lit(1))


def stem(file_name: Column) -> Column:
    """A file's name up to its first dot."""
    return F.split_part(file_name, F.lit("."), F.lit(1))


def instrument_name(described: Column) -> Column:
    """The value of the last item starting with NT= in a list separated by semicolons; without one, an error."""
    item = F.try_element_at(F.filter(F.split(described, ";"), lambda i: i.startswith("NT=")), F.lit(-1))
    missing = F.raise_error(F.concat(F.lit("no NT= item in instrument "), described)).cast("string")
    return F.when(item.isNull() & described.isNotNull(), missing).otherwise(F.substring(item, 4, 1 << 20))


def group_path(organism: Column, instrument: Column, charge: Column) -> Column:
    return F.concat(organism, F.lit("/"), instrument, F.lit("/charge"), charge.cast("string"), F.lit("/mgf files"))


def mgf_file_name(stem: Column, index: Column) -> Column:
    return F.concat(stem, F.lit("_"), index.cast("string"), F.lit(".mgf"))


def mgf_block(usi: Column, pepmass: Column, charge: Column, mz: Column, intensity: Column) -> Column:
    return F.concat_ws(
        "\n", F.lit("BEGIN IONS"), F.concat(F.lit("TITLE=id="), usi), F.concat(F.lit("PEPMASS="), float_text(pepmass)),
        F.concat(F.lit("CHARGE="), charge.cast("string"), F.lit("+")), peak_text(mz, intensity), F.lit("END IONS"),
    )


def msp_comment(usi: Column, nreps: Column, pep: Column) -> Column:
    return F.concat(F.lit("clusterID="), cluster_uuid(usi), F.lit(" Nreps="), nreps.cast("string"), F.lit(" PEP="), float_text(pep))


def msp_block(name: Column, usi: Column, pepmass: Column, nreps: Column, pep: Column, mz: Column, intensity: Column) -> Column:
    """The MW line holds the precursor m/z."""
    return F.concat_ws(
        "\n", F.concat(F.lit("Name: "), name), F.concat(F.lit("MW: "), float_text(pepmass)), F.concat(F.lit("Comment: "), msp_comment(usi, nreps, pep)),
        F.concat(F.lit("Num peaks: "), F.size(mz).cast("string")), peak_text(mz, intensity),
    )
