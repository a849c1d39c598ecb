"""Column expressions that read numbers, flags and roles out of exported text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Header patterns of the metric roles (English and Spanish exports).
METRIC_PATTERNS = (
    ("forward_result", r"^(forward\s*result|resultado\s*(del\s*)?forward|resultado\s*adelante)$"),
    ("back_result", r"^(back\s*result|resultado\s*(del\s*)?back(test)?|resultado\s*atras)$"),
    ("result", r"^(result|resultado)$"),
    ("profit", r"^(net\s*)?(profit|beneficio|ganancia|benefici[oa]\s*neto)$"),
    ("expected_payoff", r"^(expected\s*payoff|beneficio\s*esperado|esperanza\s*matem[aá]tica)$"),
    ("profit_factor",
     r"^(profit\s*factor|factor\s*de\s*(beneficio|ganancia|rentabilidad|lucro))$"),
    ("recovery_factor", r"^(recovery\s*factor|factor\s*de\s*recuperaci[oó]n)$"),
    ("sharpe", r"^(sharpe(\s*ratio)?|(ratio|coeficiente|[ií]ndice)\s*de\s*sharpe)$"),
    ("custom", r"^(custom|personalizado|criterio\s*personalizado)$"),
    ("drawdown", r"^(max(imal|imum)?\s+)?((equity|balance)\s+)?(dd|drawdown|draw\s*down)(\s|%|$)"
                 r"|^(reducci[oó]n|ca[ií]da)(\s|%|$)"),
    ("trades", r"^(total\s*)?(trades|deals|operaciones|transacciones|negociaciones|# ?deals)$"),
)
ID_PATTERN = r"^(pass|pasada|prueba|#|id)$"
KEY_METRICS = ("profit", "profit_factor", "drawdown", "trades")
BOOL_PATTERN = r"^(true|false|verdadero|falso)$"
TRUE_PATTERN = r"^(true|verdadero)$"
REPORT_PATTERN = (r"(?i)Strategy\s*Tester\s*Report|Informe\s*del\s*Probador|Testbericht"
                  r"|Rapport\s*du\s*testeur")
PLAIN_NUMBER = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"
NUMERIC_TEXT = r"^[+-]?\d[\d.,]*$"


def metric_role(header: Column) -> Column:
    """Role of a header, or NULL; the first matching pattern wins."""
    h = F.lower(F.trim(header))
    out = None
    for role, pattern in METRIC_PATTERNS:
        out = F.when(h.rlike(pattern), role) if out is None else out.when(h.rlike(pattern), role)
    return out


def is_id_header(header: Column) -> Column:
    return F.lower(F.trim(header)).rlike(ID_PATTERN)


def strip_number(text: Column) -> Column:
    """Drop blanks (also non-breaking), apostrophes and a trailing percent sign."""
    return F.regexp_replace(F.regexp_replace(text, "[\\s   ']", ""), "%$", "")


def let(value: Column, fn) -> Column:
    """``fn(value)`` with ``value`` computed once, so long rules stay short in the plan."""
    return F.get(F.transform(F.array(value), fn), F.lit(0))


def plain_double(text: Column) -> Column:
    return F.when(text.rlike(PLAIN_NUMBER), text.try_cast("double"))


def to_number(text: Column) -> Column:
    """Number of a text in either decimal convention; NULL when it is none.

    With both separators the last one is the decimal mark. A lone comma is a
    thousands mark when it repeats or when it leaves exactly three digits behind a
    short, non-zero head; otherwise it is the decimal mark.
    """
    return let(strip_number(F.trim(text)), _read_number)


def _read_number(s: Column) -> Column:
    dot, comma = s.contains("."), s.contains(",")
    comma_last = s.rlike(r"\.[^,]*,[^.]*$")
    no_comma = F.regexp_replace(s, ",", "")
    comma_decimal = F.regexp_replace(F.regexp_replace(s, "\\.", ""), ",", ".")
    thousands = s.rlike(r"^[^,]*(,[^,]*){2,}$") | (
        s.rlike(r"^\d{0,3},\d{3}$") & (F.length(s) > 4) & ~s.rlike("^0"))
    normal = (F.when(~comma, s)
              .when(dot & comma_last, comma_decimal)
              .when(dot | thousands, no_comma)
              .otherwise(F.regexp_replace(s, ",", ".")))
    return let(normal, plain_double)


def text_to_number(text: Column, decimal: Column) -> Column:
    """Number of a text once its column's decimal mark is known."""
    def read(s: Column) -> Column:
        normal = F.when(decimal == ",", F.regexp_replace(F.regexp_replace(s, "\\.", ""), ",", ".")
                        ).otherwise(F.regexp_replace(s, ",", ""))
        return F.when(s.rlike(NUMERIC_TEXT), let(normal, plain_double))
    return let(strip_number(F.trim(text)), read)


def _vote(text: Column, own: str, other: str, own_last: bool) -> Column:
    """A text votes for ``own`` as decimal mark when no other reading is possible.

    Both marks: the last one. One mark: it is decimal unless three digits follow it;
    repeated, it groups thousands and the other mark is decimal.
    """
    def rule(s: Column) -> Column:
        last = s.rlike(r"\.[^,]*,[^.]*$")
        n_own, n_other = F.regexp_count(s, F.lit(own)), F.regexp_count(s, F.lit(other))
        return s.rlike(NUMERIC_TEXT) & (
            ((n_own > 0) & (n_other > 0) & (last if own_last else ~last))
            | ((n_other == 0) & (n_own == 1) & ~s.rlike(own + r"\d{3}$"))
            | ((n_own == 0) & (n_other > 1)))
    return let(strip_number(F.trim(text)), rule)


def comma_vote(text: Column) -> Column:
    """True when a text can only be read with a decimal comma."""
    return _vote(text, ",", "\\.", True)


def dot_vote(text: Column) -> Column:
    """True when a text can only be read with a decimal dot."""
    return _vote(text, "\\.", ",", False)


def canonical(text: Column) -> Column:
    """Struct (kind, num, txt) of a parameter value; NULL when empty."""
    def read(t: Column) -> Column:
        flag = F.lower(t).rlike(BOOL_PATTERN)
        return let(to_number(t), lambda number: F.when(t != "", F.struct(
            F.when(flag, "bool").when(number.isNotNull(), "number").otherwise("text").alias("kind"),
            F.when(~flag, number).alias("num"),
            F.when(flag, F.when(F.lower(t).rlike(TRUE_PATTERN), "true").otherwise("false"))
            .when(number.isNotNull(), number.cast("string")).otherwise(t).alias("txt"))))
    return let(F.trim(text), read)
