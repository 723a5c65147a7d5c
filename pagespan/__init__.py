"""pagespan: reassembles tables that page breaks cut into fragments, as Spark DataFrames."""

from pagespan.config import StitchConfig
from pagespan.plans.engine import Adapter, Stitched, Stitcher, StitchError, extract_fragments, merge_fragments, stitch_documents

__version__ = "0.1.0"
__all__ = ["Adapter", "StitchConfig", "StitchError", "Stitched", "Stitcher", "extract_fragments", "merge_fragments", "stitch_documents"]
