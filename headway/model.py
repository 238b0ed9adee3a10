"""Schemas, fixed values, settings and session helpers."""

from __future__ import annotations

from dataclasses import dataclass
from pathlib import Path
from zipfile import ZipFile

from pyspark import SparkFiles
from pyspark.sql import SparkSession
from pyspark.sql import types as T

# --- schemas ---------------------------------------------------------------

# One timetable record: a train that leaves a station.
DEPARTURE = T.StructType([
    T.StructField("station", T.IntegerType()),
    T.StructField("train", T.StringType()),
    T.StructField("timestamp", T.TimestampType()),
    T.StructField("mode", T.StringType()),
    T.StructField("mission", T.StringType()),
    T.StructField("terminus", T.IntegerType()),
])

# The same record as it travels in a JSON message: the instant is still text.
DEPARTURE_MESSAGE = T.StructType([
    T.StructField(f.name, T.StringType() if f.name == "timestamp" else f.dataType)
    for f in DEPARTURE
])

STATION = T.StructType([
    T.StructField("station", T.IntegerType()),
    T.StructField("label", T.StringType()),
    T.StructField("latitude", T.DoubleType()),
    T.StructField("longitude", T.DoubleType()),
])

# `pos` is a branch code. "0" and "00" are different branches, so it stays text.
STATION_ORDER = T.StructType([
    T.StructField("station", T.IntegerType()),
    T.StructField("pos", T.StringType()),
    T.StructField("order", T.IntegerType()),
])

TRACK_POINT = T.StructType([
    T.StructField("depart", T.IntegerType()),
    T.StructField("arrivee", T.IntegerType()),
    T.StructField("path", T.StringType()),
    T.StructField("order_path", T.IntegerType()),
    T.StructField("order_point", T.IntegerType()),
    T.StructField("code_ligne", T.StringType()),
    T.StructField("libelle_ligne", T.StringType()),
    T.StructField("nom_voie", T.StringType()),
    T.StructField("idreseau", T.LongType()),
    T.StructField("longitude", T.DoubleType()),
    T.StructField("latitude", T.DoubleType()),
])

POINTS = T.ArrayType(T.StructType([
    T.StructField("lat", T.DoubleType()),
    T.StructField("lon", T.DoubleType()),
]))

PATH = T.StructType([
    T.StructField("from_st", T.IntegerType()),
    T.StructField("to_st", T.IntegerType()),
    T.StructField("points", POINTS),
    T.StructField("number_step", T.IntegerType()),
])

# Value of one entry of a keyed path file, `{"from-to": {...}}`.
KEYED_PATH = T.StructType([
    T.StructField("departure", T.StringType()),
    T.StructField("arrival", T.StringType()),
    T.StructField("geoPoints", T.ArrayType(T.StructType([
        T.StructField("latitude", T.StringType()),
        T.StructField("longitude", T.StringType()),
    ]))),
    T.StructField("number_step", T.IntegerType()),
])

# Value of one entry of a keyed station file, `{"code": {...}}`.
KEYED_STATION = T.StructType([
    T.StructField("label", T.StringType()),
    T.StructField("latitude", T.DoubleType()),
    T.StructField("longitude", T.DoubleType()),
])

BOARD = T.StructType([
    T.StructField("train", T.ArrayType(T.StructType([
        T.StructField("date", T.StructType([
            T.StructField("_VALUE", T.StringType()),
            T.StructField("_mode", T.StringType()),
        ])),
        T.StructField("num", T.StringType()),
        T.StructField("miss", T.StringType()),
        T.StructField("term", T.StringType()),
    ]))),
])

OPEN_DATA = T.StructType([
    T.StructField("fields", T.StructType([
        T.StructField("code_uic", T.StringType()),
        T.StructField("libelle_point_arret", T.StringType()),
        T.StructField("l", T.StringType()),
    ])),
    T.StructField("geometry", T.StructType([
        T.StructField("coordinates", T.ArrayType(T.DoubleType())),
    ])),
])

# --- fixed values ----------------------------------------------------------

# Message time formats. The closing Z is literal text: instants are session-local.
TIMESTAMP_FORMATS = ("yyyy-MM-dd'T'HH:mm:ss.SSS'Z'", "yyyy-MM-dd HH:mm:ss")
BOARD_FORMAT = "dd/MM/yyyy HH:mm"

# Missions that run towards Paris.
INBOUND_MISSIONS = ("PALS", "PASA", "PEBU", "PEGE", "POPI", "POPU", "POSA", "POVA", "POPE")

# First mission letter: terminus and the sub-lines that lead to it.
MISSION_TERMINUS = {
    "B": ("BECON LES BRUYERES", ["L1", "L2", "L3", "L4"]),
    "D": ("SAINT-CLOUD", ["L1", "L2"]),
    "F": ("MAISONS LAFFITTE", ["L4"]),
    "N": ("NANTERRE UNIVERSITÉ", ["L4"]),
    "P": ("PARIS SAINT-LAZARE (GARE SAINT-LAZARE)", ["L1", "L2", "L3", "L4"]),
    "R": ("MARLY LE ROI", ["L2", "L3"]),
    "S": ("SAINT-NOM LA BRETECHE FORET DE MARLY", ["L2", "L3"]),
    "U": ("CERGY LE HAUT", ["L4"]),
    "V": ("VERSAILLES RIVE DROITE", ["L1"]),
}

# Second mission letter: kind of service.
MISSION_SERVICE = {
    "I": "direct",
    "A": "semi direct",
    "O": "omnibus",
    "E": "autres dessertes",
    "U": "autres dessertes",
}

# Third mission letter: station served on the way.
MISSION_VIA = {
    "A": "Asnières sur Seine",
    "B": "Bécon les Bruyères",
    "C": "Clichy Levallois",
    "L": "La Défense ou Les Vallées",
    "M": "Nanterre Université",
    "P": "Pont Cardinet",
}

# Stretches of the line, and the stretches each sub-line runs over, in order.
STRETCHES = {
    "paris-becon": [
        "PARIS SAINT-LAZARE (GARE SAINT-LAZARE)", "PONT CARDINET", "CLICHY LEVALLOIS",
        "ASNIERES SUR SEINE", "BECON LES BRUYERES",
    ],
    "becon-saint-cloud": [
        "COURBEVOIE", "LA DEFENSE", "PUTEAUX", "SURESNES MONT VALERIEN", "LE VAL D'OR", "SAINT-CLOUD",
    ],
    "saint-cloud-versailles": [
        "SEVRES VILLE D'AVRAY", "CHAVILLE RIVE DROITE", "VIROFLAY RIVE DROITE", "MONTREUIL",
        "VERSAILLES RIVE DROITE",
    ],
    "saint-cloud-saint-nom": [
        "GARCHES MARNES LA COQUETTE", "VAUCRESSON", "LA CELLE SAINT-CLOUD", "BOUGIVAL",
        "LOUVECIENNES", "MARLY LE ROI", "L'ETANG LA VILLE", "SAINT-NOM LA BRETECHE FORET DE MARLY",
    ],
    "noisy-saint-germain": [
        "NOISY LE ROI", "SAINT-NOM LA BRETECHE FORET DE MARLY", "MAREIL MARLY",
        "SAINT-GERMAIN EN LAYE BEL AIR FOURQUEUX", "SAINT-GERMAIN EN LAYE GRANDE CEINTURE",
    ],
    "becon-cergy": [
        "LES VALLEES", "LA GARENNE COLOMBES", "NANTERRE UNIVERSITÉ", "HOUILLES CARRIERES SUR SEINE",
        "SARTROUVILLE", "MAISONS LAFFITTE", "ACHERES VILLE", "CONFLANS FIN D'OISE",
        "NEUVILLE UNIVERSITÉ", "CERGY PREFECTURE", "CERGY SAINT-CHRISTOPHE", "CERGY LE HAUT",
    ],
}
SUB_LINES = {
    "L1": ["paris-becon", "becon-saint-cloud", "saint-cloud-versailles"],
    "L2": ["paris-becon", "becon-saint-cloud", "saint-cloud-saint-nom"],
    "L3": ["noisy-saint-germain"],
    "L4": ["paris-becon", "becon-cergy"],
}


@dataclass(frozen=True)
class Settings:
    """Parameters of the two reports and of their streams."""

    window_minutes: int = 60
    slide_minutes: int = 2
    watermark_minutes: int = 1
    trigger_seconds: int = 2
    around_seconds: int = 3600
    repeat_horizon: str = "8 hours"
    inbound_missions: tuple[str, ...] = INBOUND_MISSIONS


# --- session and shared storage --------------------------------------------

def session(app: str = "headway", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the library counts on; `conf` adds or overrides."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    wanted = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.ansi.enabled": "true",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
        "spark.sql.streaming.stateStore.providerClass":
            "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
        **conf,
    }
    for key, value in wanted.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    ship_package(spark)
    return spark


_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Sends this package to the executors, once per application, so that Python functions find it there."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    _shipped.add(context.applicationId)
    package = Path(__file__).parent
    target = Path(SparkFiles.getRootDirectory()) / f"{package.name}-code.zip"
    with ZipFile(target, "w") as archive:
        for file in sorted(package.rglob("*.py")):
            archive.write(file, file.relative_to(package.parent))
    context.addPyFile(str(target))


def shared_folder(spark: SparkSession) -> str:
    """This application's folder in the place all executors see.

    The place is `spark.checkpoint.dir`; where that is unset, a folder in the warehouse, unless that is a folder of each
    machine's own: on a cluster this is an error. The folder goes when the application ends.
    """
    context = spark.sparkContext
    jvm = context._jvm
    place = spark.conf.get("spark.checkpoint.dir", None)
    if not place:
        place = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_headway"
        path = jvm.org.apache.hadoop.fs.Path(place)
        scheme = path.getFileSystem(context._jsc.hadoopConfiguration()).getUri().getScheme()
        if scheme == "file" and not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir is unset, and the warehouse is not a folder that all machines share")
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(place)
    folder = f"{place.rstrip('/')}/{context.applicationId}"
    path = jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(context._jsc.hadoopConfiguration()).deleteOnExit(path)
    return folder
