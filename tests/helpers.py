import datetime as dt
import decimal
import math


def cell(value):
    """A value as comparable text; integers and floats of equal value differ only by type."""
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(round(value, 6) + 0.0)
    if isinstance(value, decimal.Decimal):
        return repr(float(value))
    if isinstance(value, bool):
        return f"bool {value}"
    if isinstance(value, int):
        return str(value)
    if isinstance(value, dt.datetime):
        return value.isoformat()
    return repr(value)


def bag(rows, columns, order=None):
    """Rows as a sorted list of texts, with the columns in a fixed order."""
    names = order or sorted(columns)
    at = [columns.index(n) for n in names]
    return sorted(tuple(cell(r[i]) for i in at) for r in rows)


def rows_of(df):
    return bag(df.collect(), df.columns, list(df.columns))


def physical_plan(df):
    return df._jdf.queryExecution().executedPlan().toString()
