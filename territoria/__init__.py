"""Territorial analytics on Spark: DataFrame operators for site scoring, drought indices,
spatial interpolation, energy mixes, network statistics and resampling inference."""

from territoria.session import cut_lineage, get_session

__all__ = ["cut_lineage", "get_session"]
