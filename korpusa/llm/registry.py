"""The queries of this subpackage, and the SQL of those that SQL can express."""

from __future__ import annotations

from . import bpe, decontaminate, exact, extract, importance, knn, langid, periodic, pii, simhash, substrings, urls, wavelet

QUERIES = {
    "op1_simhash": simhash.query,
    "op2_voronoi_knn": knn.query,
    "op8_url_filter": urls.query,
    "op9_pii": pii.query,
    "op3_substring_dedup": substrings.query,
    "op4_html_extract": extract.query,
    "op5_language_id": langid.query,
    "op6_decontaminate": decontaminate.query,
    "op7_byte_bpe": bpe.query,
    "op10_wavelet": wavelet.query,
    "op11_exact_dedup": exact.query,
    "op12_periodic_runs": periodic.query,
    "op13_importance_resampling": importance.query,
}
ORACLES: dict[str, str] = {
    "op2_voronoi_knn": knn.ORACLE,
    "op3_substring_dedup": substrings.ORACLE,
    "op11_exact_dedup": exact.ORACLE,
    "op13_importance_resampling": importance.ORACLE,
}
