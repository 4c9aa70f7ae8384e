"""Checks of recognised equations."""

from __future__ import annotations

import ast
import operator

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import DoubleType

from vidlake.functions.text import round_any, split_tokens

NUMBER = r"[0-9]+(?:\.[0-9]+)?"
_LEADING = r"^\s*([+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?)"
_BINARY = rf"^\s*({NUMBER})\s*([-+*/])\s*({NUMBER})\s*$"


def _sides(text: Column) -> tuple[Column, Column, Column]:
    """(whether there are two filled sides, the left as arithmetic, the right)."""
    parts = split_tokens(text, "=")
    left, right = F.get(parts, 0), F.get(parts, 1)
    good = (F.size(parts) == 2) & (left != "") & (right != "")
    return good, F.replace(F.replace(left, F.lit("x"), F.lit("*")), F.lit("÷"), F.lit("/")), right


def _flag(good: Column, left: Column, right: Column) -> Column:
    value = F.regexp_extract(right, _LEADING, 1)
    said = F.when(value != "", value.cast("double"))
    fine = good & left.isNotNull() & said.isNotNull()
    return F.when(fine, F.concat(F.when(left == said, "yes_").otherwise("no_"), round_any(left, 2))).otherwise("invalid")


def _binary(arithmetic: Column) -> Column:
    """The value of a op b."""
    part = lambda k: F.regexp_extract(arithmetic, _BINARY, k)
    a, b = F.when(part(1) != "", part(1).cast("double")), F.when(part(3) != "", part(3).cast("double"))
    op = part(2)
    return F.when(op == "+", a + b).when(op == "-", a - b).when(op == "*", a * b).when((op == "/") & (b != 0), a / F.when(b != 0, b))


def check_binary(texts: DataFrame) -> DataFrame:
    """texts (text) with flag: yes_v or no_v for `a op b = c` with v = a op b, else invalid. Native expressions only."""
    good, arithmetic, right = _sides(F.col("text"))
    return texts.withColumn("flag", _flag(good, _binary(arithmetic), right))


_OPS = {ast.Add: operator.add, ast.Sub: operator.sub, ast.Mult: operator.mul, ast.Div: operator.truediv, ast.Pow: operator.pow, ast.USub: operator.neg, ast.UAdd: operator.pos}


def _value(node: ast.AST) -> float:
    if isinstance(node, ast.Expression):
        return _value(node.body)
    if isinstance(node, ast.BinOp) and type(node.op) in _OPS:
        return _OPS[type(node.op)](_value(node.left), _value(node.right))
    if isinstance(node, ast.UnaryOp) and type(node.op) in _OPS:
        return _OPS[type(node.op)](_value(node.operand))
    if isinstance(node, ast.Constant) and isinstance(node.value, (int, float)) and not isinstance(node.value, bool):
        return float(node.value)
    raise ValueError("not arithmetic")


def _evaluate(text: str | None) -> float | None:
    try:
        out = _value(ast.parse((text or "").strip().replace("^", "**"), mode="eval"))
        return out if isinstance(out, float) and abs(out) < 1e300 else None
    except (ValueError, SyntaxError, ZeroDivisionError, OverflowError, RecursionError, MemoryError):
        return None


@F.pandas_udf(DoubleType())
def evaluate(texts: pd.Series) -> pd.Series:
    """Values of + - * / ^ and brackets; null for anything else."""
    known = {t: _evaluate(t) if t else None for t in texts.unique()}
    return texts.map(known).astype("float64")


def check_equations(texts: DataFrame) -> DataFrame:
    """As check_binary, for any arithmetic on the left; only what is no single operation goes to Python."""
    good, arithmetic, right = _sides(F.col("text"))
    plain = F.coalesce(arithmetic.rlike(_BINARY), F.lit(False))
    asked = F.when(plain | ~good, F.lit("")).otherwise(F.coalesce(arithmetic, F.lit("")))
    left = F.when(plain, _binary(arithmetic)).otherwise(F.nanvl(evaluate(asked), F.lit(None).cast("double")))
    return texts.withColumn("flag", _flag(good, left, right))


def equation_summary(texts: DataFrame) -> DataFrame:
    """Per frame: how many texts, how many right, wrong and invalid, and the texts in order of target_no."""
    return texts.groupBy("channel_index", "frame_index").agg(
        F.count(F.lit(1)).alias("total"), F.count_if(F.col("flag").contains("yes")).alias("yes"), F.count_if(F.col("flag").contains("no_")).alias("no"), F.count_if(F.col("flag").contains("invalid")).alias("invalid"),
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("target_no", "text"))), lambda t: t["text"]), ",").alias("texts"),
    )
