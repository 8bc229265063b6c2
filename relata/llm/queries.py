"""Registered queries of this subpackage: name -> (spark, sf_dir) -> DataFrame."""

from __future__ import annotations

from .decontaminate import decontaminate_query
from .language import language_query
from .linededup import linededup_query
from .mixing import MIXING_SQL, mixing_query
from .passages import passages_query
from .quality import quality_query
from .secrets import SECRETS_SQL, secrets_query
from .simhash import simhash_query
from .suffixes import suffixes_query
from .tokens import tokens_query

QUERIES = {
    "op1_tokens": tokens_query,
    "op2_mixing": mixing_query,
    "op3_secrets": secrets_query,
    "op4_simhash": simhash_query,
    "op5_linededup": linededup_query,
    "op6_decontaminate": decontaminate_query,
    "op7_language": language_query,
    "op8_passages": passages_query,
    "op9_suffixes": suffixes_query,
    "op10_quality": quality_query,
}

ORACLES: dict[str, str] = {
    "op2_mixing": MIXING_SQL,
    "op3_secrets": SECRETS_SQL,
}
