"""The queries of this folder by name, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from sparkloft.llm.decontaminate import op2_decontamination
from sparkloft.llm.exact_dedup import op11_exact_dedup
from sparkloft.llm.hard_negatives import op12_hard_negatives
from sparkloft.llm.imatch import op4_imatch_fingerprints
from sparkloft.llm.licenses import op8_license_scan
from sparkloft.llm.oracle import ORACLE_SQL
from sparkloft.llm.packing import op6_best_fit_packing
from sparkloft.llm.quality import op9_quality_classifier
from sparkloft.llm.secret_scans import op5_secret_scans
from sparkloft.llm.simhash import op1_simhash_near_dedup
from sparkloft.llm.toxicity import op10_toxicity
from sparkloft.llm.url_filters import op3_url_filters
from sparkloft.llm.warc import op7_warc
from sparkloft.llm.whitening import op13_whitening

QUERIES = {
    "op1_simhash_near_dedup": op1_simhash_near_dedup,
    "op2_decontamination": op2_decontamination,
    "op3_url_filters": op3_url_filters,
    "op4_imatch_fingerprints": op4_imatch_fingerprints,
    "op5_secret_scans": op5_secret_scans,
    "op6_best_fit_packing": op6_best_fit_packing,
    "op7_warc": op7_warc,
    "op8_license_scan": op8_license_scan,
    "op9_quality_classifier": op9_quality_classifier,
    "op10_toxicity": op10_toxicity,
    "op11_exact_dedup": op11_exact_dedup,
    "op12_hard_negatives": op12_hard_negatives,
    "op13_whitening": op13_whitening,
}

__all__ = ["ORACLE_SQL", "QUERIES"]
