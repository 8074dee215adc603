"""Number formats, rounding as C's printf does (ties by the exact binary value)."""


def fixed(value: str, decimals: int) -> str:
    pattern = "0" + ("." + "0" * decimals if decimals else "")
    return f"format_number({value}, '{pattern}')"


def percent(value: str) -> str:
    return f"concat(format_number({value} * 100D, '0'), '%')"
