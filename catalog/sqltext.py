"""SQL text for the parts many statements share."""

from __future__ import annotations


def draw(seed: str, k: str = "0") -> str:
    """The k-th uniform number of a seed, in unsigned 64-bit arithmetic."""
    mask = "4294967295::UBIGINT"
    a = f"(((({seed})::UBIGINT) + (((({k})::UBIGINT) + 1) * 1831565813::UBIGINT) % 4294967296) % 4294967296)"
    t = f"((xor({a}, {a} >> 15) * ({a} | 1::UBIGINT)) & {mask})"
    u = f"xor({t}, ({t} + ((xor({t}, {t} >> 7) * ({t} | 61::UBIGINT)) & {mask})) & {mask})"
    return f"(xor({u}, {u} >> 14)::DOUBLE / 4294967296.0)"


def draw_int(seed: str, k: str, n: str) -> str:
    return f"CAST(floor({draw(seed, k)} * ({n})) AS INTEGER)"


def fnv(text: str) -> str:
    """32-bit FNV-1a of the UTF-8 bytes of a text."""
    return (
        f"list_reduce(list_transform(regexp_extract_all(hex({text}), '..'), lambda b: ('0x' || b)::UBIGINT), "
        f"lambda h, c: (xor(h, c) * 16777619::UBIGINT) & 4294967295::UBIGINT, 2166136261::UBIGINT)"
    )


SPACE = r"[\t\n\x0B\f\r\x1C-\x1F\x{85}\p{Z}]"


def strip(text: str) -> str:
    return rf"regexp_replace({text}, '\A{SPACE}+|{SPACE}+\z', '', 'g')"


def seed_of_text(text: str) -> str:
    """Digit strings modulo 2^32, anything else hashed."""
    s = strip(f"coalesce({text}, '')")
    number = f"(((({s})::HUGEINT % 4294967296) + 4294967296) % 4294967296)"
    return f"(CASE WHEN regexp_full_match({s}, '-?[0-9]+') THEN {number}::BIGINT ELSE ({fnv(s)})::BIGINT END)"


def parse_answer(text: str) -> str:
    t = f"coalesce({text}, '')"
    found = rf"regexp_extract_all({t}, '(?i)ANSWER:{SPACE}*(YES|NO)(?:\z|[^\p{{L}}\p{{N}}_])', 1)"
    last = f"string_split({strip(t)}, chr(10))[-1]"

    def has(word: str) -> str:
        return rf"regexp_matches({last}, '(?i)(?:\A|[^\p{{L}}\p{{N}}_]){word}(?:\z|[^\p{{L}}\p{{N}}_])')"

    return (
        f"(CASE WHEN len({found}) > 0 THEN lower({found}[-1]) "
        f"WHEN {has('yes')} AND NOT {has('no')} THEN 'yes' "
        f"WHEN {has('no')} AND NOT {has('yes')} THEN 'no' ELSE 'unparsed' END)"
    )


def probit(p: str) -> str:
    """Inverse normal distribution function, three branches."""
    centre_top = (-3.969683028665376e+01, 2.209460984245205e+02, -2.759285104469687e+02,
                  1.383577518672690e+02, -3.066479806614716e+01, 2.506628277459239e+00)
    centre_bottom = (-5.447609879822406e+01, 1.615858368580409e+02, -1.556989798598866e+02,
                     6.680131188771972e+01, -1.328068155288572e+01, 1.0)
    tail_top = (-7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e+00,
                -2.549732539343734e+00, 4.374664141464968e+00, 2.938163982698783e+00)
    tail_bottom = (7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e+00,
                   3.754408661907416e+00, 1.0)

    def poly(cs, x):
        out = f"({cs[0]!r}::DOUBLE)"
        for c in cs[1:]:
            out = f"({out} * {x} + ({c!r}::DOUBLE))"
        return out

    def tail(q):
        x = f"sqrt(-2.0 * ln({q}))"
        return f"({poly(tail_top, x)} / {poly(tail_bottom, x)})"

    q = f"(({p}) - 0.5::DOUBLE)"
    r = f"({q} * {q})"
    centre = f"({q} * {poly(centre_top, r)} / {poly(centre_bottom, r)})"
    return (
        f"(CASE WHEN ({p}) <= 0 OR ({p}) >= 1 THEN NULL WHEN ({p}) < 0.02425 THEN {tail(p)} "
        f"WHEN ({p}) > 0.97575 THEN -{tail(f'(1 - ({p}))')} ELSE {centre} END)"
    )


COUNTS = (
    ("count(*)", "n"),
    ("count(*) FILTER (answer IN ('yes', 'no'))", "answered"),
    ("count(*) FILTER ((answer = 'yes' AND solvable) OR (answer = 'no' AND NOT solvable))", "correct"),
    ("count(*) FILTER (answer IN ('yes', 'no') AND solvable)", "positives"),
    ("count(*) FILTER (answer IN ('yes', 'no') AND NOT solvable)", "negatives"),
    ("count(*) FILTER (answer = 'yes' AND solvable)", "hits"),
    ("count(*) FILTER (answer = 'yes' AND NOT solvable)", "false_alarms"),
    ("count(*) FILTER (answer = 'refused')", "refused"),
    ("count(*) FILTER (answer = 'error')", "errors"),
    ("count(*) FILTER (answer = 'unparsed')", "unparsed"),
    ("sum(coalesce(input_tokens, 0))", "input_tokens"),
    ("sum(coalesce(output_tokens, 0))", "output_tokens"),
)


def _rates(lead: str, counted: str) -> str:
    hit = "((hits + 0.5::DOUBLE) / (positives + 1))"
    alarm = "((false_alarms + 0.5::DOUBLE) / (negatives + 1))"
    return f"""
SELECT {lead}n, answered, correct,
  round(correct::DOUBLE / nullif(answered, 0), 6) AS accuracy,
  round(hits::DOUBLE / nullif(positives, 0), 6) AS hit_rate,
  round(false_alarms::DOUBLE / nullif(negatives, 0), 6) AS fa_rate,
  CASE WHEN positives > 0 AND negatives > 0
    THEN round({probit(hit)} - {probit(alarm)}, 6) END AS dprime,
  refused, errors, unparsed, coalesce(input_tokens, 0)::BIGINT AS input_tokens, coalesce(output_tokens, 0)::BIGINT AS output_tokens
FROM ({counted})"""


def summary(source: str, by: str = "", keep: str | None = None) -> str:
    """Summary of result rows (``solvable`` boolean, ``answer``, token columns) per group."""
    keep = by if keep is None else keep
    inner = ", ".join(([by] if by else []) + [f"{count} AS {name}" for count, name in COUNTS])
    return _rates(f"{keep}, " if keep else "", f"SELECT {inner} FROM ({source}) {f'GROUP BY {by}' if by else ''}")


def summary_after_each(source: str, order: str, by: str = "") -> str:
    """The summary of all results so far after each one."""
    so_far = f"OVER ({f'PARTITION BY {by} ' if by else ''}ORDER BY {order} ROWS UNBOUNDED PRECEDING)"
    lead = f"{by}, {order}" if by else order
    inner = ", ".join([lead, *(f"{count} {so_far} AS {name}" for count, name in COUNTS)])
    return _rates(f"{lead}, ", f"SELECT {inner} FROM ({source})")
