"""Spark-native semantic analytics: relational and semantic operators over DataFrames.

    import semloom as sl

    emails = sl.TextFileDataset("emails", "/data/emails")
    kept = emails.sem_filter("The text is about 'budget'").sem_map([{"name": "sender", "type": str, "desc": "regex: From: (.*)"}])
    frame = kept.run(max_quality=True).to_df()
"""

from .context import AgentProvider, Context, ContextManager, LocalAgent, TextFileContext
from .dataset import Cardinality, DataRecordCollection, Dataset
from .functions.groupby import GroupBySig
from .operators.http_provider import HTTPProvider
from .operators.provider import CachedProvider, Completion, LocalProvider, ModelProvider, Request
from .operators.topk import VectorIndex
from .plans.models import Model, ModelCard, register, register_cards
from .plans.policy import MaxQuality, MaxQualityAtFixedCost, MaxQualityAtFixedTime, MinCost, MinCostAtFixedQuality, MinTime, MinTimeAtFixedQuality, PlanCost, Policy
from .sampling import Validator
from .session import QueryProcessorConfig
from .sources import AudioFileDataset, FrameDataset, HTMLFileDataset, ImageFileDataset, IterDataset, MemoryDataset, PDFFileDataset, TextFileDataset, XLSFileDataset, get_local_source, resolve_datasource
from .types import AudioBase64, AudioFilepath, ImageBase64, ImageFilepath, ImageURL, SchemaBuilder

__all__ = [
    "AgentProvider", "AudioBase64", "AudioFileDataset", "AudioFilepath", "CachedProvider", "Cardinality", "Completion", "Context", "ContextManager", "DataRecordCollection",
    "Dataset", "FrameDataset", "GroupBySig", "HTMLFileDataset", "HTTPProvider", "ImageBase64", "ImageFileDataset", "ImageFilepath", "ImageURL", "IterDataset", "LocalAgent", "LocalProvider",
    "MaxQuality", "MaxQualityAtFixedCost", "MaxQualityAtFixedTime", "MemoryDataset", "MinCost", "MinCostAtFixedQuality", "MinTime", "MinTimeAtFixedQuality", "Model", "ModelCard",
    "ModelProvider", "PDFFileDataset", "PlanCost", "Policy", "QueryProcessorConfig", "Request", "SchemaBuilder", "TextFileContext", "TextFileDataset", "Validator", "VectorIndex",
    "XLSFileDataset", "get_local_source", "register", "register_cards", "resolve_datasource",
]
