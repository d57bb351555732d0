"""Learned scorers of pairs: features as a stage of a pipeline that is stored with its model, and small networks.

Features are columns, so building them needs no Python. A network's weights, some
thousands of numbers, travel once with the function; whole Arrow batches are multiplied.
"""

from __future__ import annotations

import json
from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark import keyword_only
from pyspark.ml import PipelineModel, Transformer
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from .evaluation import train_logistic

# Features in the order in which models take them.
PAIR_FEATURES = (
    "score_skills", "score_experience", "score_education", "score_location", "score_semantic", "candidate_years", "candidate_education_level",
    "candidate_total_skills", "required_skills_count", "offer_title_len", "offer_desc_len", "candidate_text_len",
)
#: Those that an offer or a profile has before any pair.
OFFER_FEATURES = ("required_skills_count", "offer_title_len", "offer_desc_len")
PROFILE_FEATURES = ("candidate_years", "candidate_education_level", "candidate_total_skills", "candidate_text_len")
ENCODER_FEATURES = (*PAIR_FEATURES, "bert_raw", "bert_semantic", "bert_skills")
_NETWORK = ("semantic", "skills", "experience", "formation", "reranked", "study_fit", "domain_share", "title_skill", "critical_share", "offer_type")
NETWORK_FEATURES = {n: _NETWORK[:n] for n in (7, 9, 10)}
#: A network's share in the score it is blended with, by its number of features.
NETWORK_SHARES = {7: 0.10, 9: 0.10, 10: 0.40}
NEUTRAL = 0.5


#: What features read of the documents of a pair; numbers as text, as they may be texts that hold numbers.
_COMPONENTS = ("skills", "experience", "education", "location", "semantic")
_DETAILS = f"components struct<{', '.join(f'{p}: struct<score: string>' for p in _COMPONENTS)}>"
_PROFILE = "metadata struct<annees_experience_totales: string, niveau_formation_max: string>, competences string"
_ENCODER = "total_raw string, total string, bert_semantic string, bert_skills string"


def _document(json_text: str, schema: str) -> Column:
    """A JSON document as a struct, with its text in ``_corrupt_record`` if it does not fit the schema."""
    options = {"allowUnquotedControlChars": "true", "allowNonNumericNumbers": "false", "columnNameOfCorruptRecord": "_corrupt_record"}
    return F.from_json(json_text, f"{schema}, _corrupt_record string", options)


def _text(json_text: str, path: str) -> Column:
    """What stands at a path of a parsed document; one that does not fit the schema is read path by path, null if malformed."""
    fits = F.col(f"_{json_text}._corrupt_record").isNull()
    return F.when(fits, F.col(f"_{json_text}.{path}")).otherwise(F.get_json_object(json_text, f"$.{path}"))


def _read(value: Column) -> Column:
    """A text as a number; null where it is none. Without a digit or an n it is no number, not even NaN or an infinite one."""
    return F.when(value.rlike("[0-9nN]"), value.try_cast("double"))


def _number(name: str) -> Column:
    """A finite number of a column of doubles; 0 where there is none."""
    value = F.col(name)
    return F.coalesce(F.when(~F.isnan(value) & (F.abs(value) < float("inf")), value), F.lit(0.0))


def _with_numbers(rows: DataFrame, document: str, schema: str, numbers: dict[str, str], made: dict[str, Column] | None = None) -> DataFrame:
    """The rows with numbers by name, each from a path of a document that is parsed once, and what is made of these (``_<name>``, may be null) or the document.

    Every step is one of its own: an expression that names a value several times would read it as often.
    """
    whole = f"_{document}"
    read = rows.withColumn(whole, _document(document, schema)).withColumns({f"_{n}": _read(_text(document, path)) for n, path in numbers.items()})
    done = read.withColumns({n: _number(f"_{n}") for n in numbers if n not in (made or {})} | (made or {}))
    return done.drop(whole, *[f"_{n}" for n in numbers])


def _length(text: str) -> Column:
    return F.coalesce(F.length(text), F.lit(0)).cast("double")


def profile_features(profiles: DataFrame) -> DataFrame:
    """Profiles (parsed_data as JSON, raw_text) with the features that are theirs alone: once a profile, before any join."""
    made = {
        "candidate_education_level": F.coalesce(F.col("_candidate_education_level").try_cast("bigint"), F.lit(0)).cast("double"),
        "candidate_total_skills": F.coalesce(F.json_array_length(_text("parsed_data", "competences")), F.lit(0)).cast("double"),
        "candidate_text_len": _length("raw_text"),
    }
    paths = {"candidate_years": "metadata.annees_experience_totales", "candidate_education_level": "metadata.niveau_formation_max"}
    return _with_numbers(profiles, "parsed_data", _PROFILE, paths, made)


def offer_features(offers: DataFrame) -> DataFrame:
    """Offers (required, titre, description) with the features that are theirs alone."""
    return offers.withColumns({
        "required_skills_count": F.coalesce(F.array_size("required"), F.lit(0)).cast("double"),
        "offer_title_len": _length("titre"), "offer_desc_len": _length("description"),
    })


class PairFeatures(Transformer, DefaultParamsReadable, DefaultParamsWritable):
    """Twelve features of a pair as double columns, fifteen with those of an encoder.

    Pairs hold details, parsed_data and, with an encoder, encoder_details as JSON;
    required (array), titre, description and raw_text. What is missing, malformed or no
    finite number is 0, of a name that a document repeats the last counts; columns of the
    features' names are replaced. Pairs without parsed_data bring what ``profile_features``
    makes, those without titre what ``offer_features`` does.
    """

    encoder = Param(Params._dummy(), "encoder", "whether encoder_details give three more features", TypeConverters.toBoolean)

    @keyword_only
    def __init__(self, *, encoder: bool = False):
        super().__init__()
        self._setDefault(encoder=False)
        self._set(**self._input_kwargs)

    def features(self) -> tuple[str, ...]:
        return ENCODER_FEATURES if self.getOrDefault(self.encoder) else PAIR_FEATURES

    def _transform(self, dataset: DataFrame) -> DataFrame:
        rows = profile_features(dataset) if "parsed_data" in dataset.columns else dataset
        rows = offer_features(rows) if "titre" in dataset.columns else rows
        rows = _with_numbers(rows, "details", _DETAILS, {f"score_{p}": f"components.{p}.score" for p in _COMPONENTS})
        if self.getOrDefault(self.encoder):
            raw = F.coalesce(F.when(F.col("_bert_raw").isNotNull(), _number("_bert_raw")), _number("_bert_total"))
            paths = {"bert_raw": "total_raw", "bert_total": "total", "bert_semantic": "bert_semantic", "bert_skills": "bert_skills"}
            rows = _with_numbers(rows, "encoder_details", _ENCODER, paths, {"bert_raw": raw}).drop("bert_total")
        return rows


def train(labelled: DataFrame, encoder: bool = False, seed: int = 42) -> tuple[PipelineModel, DataFrame]:
    """A pipeline from pairs (id, label and what the features need) to a probability, and its held-out rows with predictions."""
    features = PairFeatures(encoder=encoder)
    return train_logistic(labelled, features.features(), seed, before=[features])


def scored(pairs: DataFrame, model: PipelineModel | None, reason: str | None = None, into: str = "learned_score") -> DataFrame:
    """The pairs with a probability, ready and reason; without a model all are neutral and not ready."""
    if model is None:
        return pairs.withColumns({into: F.lit(NEUTRAL), "ready": F.lit(False), "reason": F.lit(reason or "model_unavailable")})
    from pyspark.ml.functions import vector_to_array

    # Names that the model makes give way only where the pairs do not have them.
    kept = [c for c in pairs.columns if c not in (into, "ready", "reason")]
    bare = pairs.select(F.struct(*kept).alias("_row"), *[c for c in kept if c not in ("prediction", "probability", "rawPrediction", "_features", "_weight")])
    found = model.transform(bare)
    return found.select("_row.*", vector_to_array("probability")[1].alias(into), F.lit(True).alias("ready"), F.lit(None).cast("string").alias("reason"))


class Network(Transformer, DefaultParamsReadable, DefaultParamsWritable):
    """A network of linear layers with ReLU between them and a sigmoid at the end, over 7, 9 or 10 features.

    A null or non-finite feature makes the score null. Weights are stored with the stage.
    """

    layers = Param(Params._dummy(), "layers", "rows of weights and the bias of each layer")
    output = Param(Params._dummy(), "output", "column of the score", TypeConverters.toString)

    @keyword_only
    def __init__(self, *, layers: Sequence | None = None, output: str = "network_score"):
        super().__init__()
        self._setDefault(output="network_score")
        self._set(**self._input_kwargs)

    @classmethod
    def of_state(cls, state: Mapping[str, Sequence], epsilon: float = 1e-5) -> Network:
        """A network from named weights as "net.<place>.weight"; a normalisation is folded into the linear layer before it.

        Raises KeyError or ValueError where names are missing or shapes do not fit.
        """
        arrays = {k: np.asarray(v, "float64") for k, v in state.items()}
        places = sorted({int(k.split(".")[1]) for k in arrays})
        layers: list[list] = []
        for p in places:
            weight, bias = arrays[f"net.{p}.weight"], arrays[f"net.{p}.bias"]
            if weight.ndim == 2:
                layers.append([weight, bias])
                continue
            scale = weight / np.sqrt(arrays[f"net.{p}.running_var"] + epsilon)
            before, offset = layers[-1]
            layers[-1] = [before * scale[:, None], (offset - arrays[f"net.{p}.running_mean"]) * scale + bias]
        width = layers[0][0].shape[1]
        if width not in NETWORK_FEATURES:
            raise ValueError(f"no network of {width} features")
        for weight, bias in layers:
            if weight.shape != (len(bias), width):
                raise ValueError(f"a layer of {weight.shape} behind {width} values")
            width = len(bias)
        if width != 1:
            raise ValueError(f"{width} outputs")
        return cls(layers=[[w.tolist(), b.tolist()] for w, b in layers])

    def features(self) -> tuple[str, ...]:
        return NETWORK_FEATURES[len(self.getOrDefault(self.layers)[0][0][0])]

    def _transform(self, dataset: DataFrame) -> DataFrame:
        layers = [(np.asarray(w, "float64").T, np.asarray(b, "float64")) for w, b in self.getOrDefault(self.layers)]

        @F.pandas_udf("double")
        def forward(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
            for batch in batches:
                x = np.column_stack([s.to_numpy("float64", na_value=np.nan) for s in batch])
                fine = np.isfinite(x).all(1)
                x = np.where(fine[:, None], x, 0.0)
                for place, (weight, bias) in enumerate(layers, 1):
                    x = x @ weight + bias
                    if place < len(layers):
                        x = np.maximum(x, 0.0)
                score = np.exp(-np.logaddexp(0.0, -x[:, 0]))
                yield pd.Series(score).where(pd.Series(fine), None)

        score = forward(*[F.col(f).cast("double") for f in self.features()])
        return dataset.withColumn(self.getOrDefault(self.output), F.when(~F.isnan(score), score))


def read_network(spark: SparkSession, paths: Sequence[str]) -> tuple[Network | None, str | None]:
    """The network of the first path that is there (a JSON object of named weights), or None with the reason."""
    for path in paths:
        try:
            state = json.loads(spark.read.text(path, wholetext=True).first()[0])
            if not isinstance(state, dict):
                raise TypeError("no object")
            return Network.of_state(state), None
        except AnalysisException:  # not there: the next one
            continue
        except (KeyError, IndexError, TypeError, ValueError) as error:  # there, but no network
            return None, f"load_error:{type(error).__name__}"
    return None, "artifact_missing"


def blended(base: Column, network: Column, features: int) -> Column:
    """A score blended with a network's; the score itself where the network has none."""
    share = NETWORK_SHARES[features]
    return F.coalesce(F.floor((network * share + base * (1.0 - share)) * 10_000 + 0.5) / 10_000, base)
