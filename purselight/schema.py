"""Schemas, column roles and fixed vocabularies of transaction histories."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import types as T

#: Internal columns of a transaction table; the optional ones may be missing.
REQUIRED = ("customer_id", "tr_datetime", "amount", "mcc_code_desc", "label")
OPTIONAL = ("currency_name", "trx_cat_ru", "mcc_desc")
RAW_CHURN = ("cl_id", "MCC", "currency", "TRDATETIME", "amount", "trx_category", "target_flag")

EXPLANATIONS = T.StructType(
    [
        T.StructField("customer_id", T.LongType()), T.StructField("label", T.IntegerType()), T.StructField("label_name", T.StringType()), T.StructField("sample_id", T.IntegerType()), T.StructField("explanation", T.StringType()),
        T.StructField("predicted_raw", T.StringType()), T.StructField("predicted", T.IntegerType()), T.StructField("execution_time", T.DoubleType()), T.StructField("error", T.StringType()),
    ]
)
CLAIMS = T.StructType([T.StructField("customer_id", T.LongType()), T.StructField("label", T.IntegerType()), T.StructField("label_name", T.StringType()), T.StructField("claims", T.ArrayType(T.StringType()))])

# Names that results must carry.
WEEKDAYS = ("Пн", "Вт", "Ср", "Чт", "Пт", "Сб", "Вс")
PERIODS = ("утро", "день", "вечер", "ночь")
NO_CATEGORY, NO_DATA = "нет выраженных категорий", "нет данных"
POS, DEPOSIT, C2C_OUT, C2C_IN, CASH = "оплата картой", "пополнение счета", "перевод на карту", "входящий перевод с карты", "снятие"
RUB = "Рубль"
CURRENCIES = {
    810: "Рубль", 643: "Рубль", 978: "Евро", 840: "Доллар США", 826: "Фунт стерлингов", 756: "Швейцарский франк", 156: "Китайский юань",
    392: "Японская иена", 980: "Украинская гривна", 398: "Казахстанский тенге",
}
OPERATION_TYPES = {
    "POS": "оплата картой", "WD_ATM_PARTNER": "снятие наличных (банкомат партнера)", "WD_ATM_ROS": "снятие наличных (банкомат Росбанка)",
    "WD_ATM_OTHER": "снятие наличных (другой банк)", "CAT": "снятие наличных через кассу", "DEPOSIT": "пополнение счета", "C2C_OUT": "перевод на карту",
    "C2C_IN": "входящий перевод с карты", "MBO": "мобильный банк", "WEB": "интернет-банк", "BACK": "возврат средств",
}
MERCHANT_CODES = {
    4111: "Городской транспорт", 4112: "Железная дорога", 4121: "Такси", 4131: "Автобусы",
    4511: "Авиабилеты", 4722: "Туристические агентства", 4812: "Телеком", 4814: "Телеком",
    4816: "Интернет-сервисы", 4829: "Денежные переводы", 4899: "Кабельные и платные сервисы",
    4900: "ЖКХ", 5122: "Лекарства", 5200: "Строительные материалы", 5211: "Стройматериалы",
    5231: "Стекло и краски", 5251: "Скобяные товары", 5261: "Садовые принадлежности",
    5310: "Универсальные магазины", 5311: "Универмаги", 5331: "Дисконт-магазины",
    5399: "Разные магазины", 5411: "Супермаркеты", 5412: "Продуктовые магазины",
    5422: "Мясные магазины", 5441: "Кондитерские", 5451: "Молочные продукты", 5462: "Булочные",
    5499: "Продовольственные магазины", 5511: "Автосалоны", 5531: "Автозапчасти",
    5532: "Автошины", 5533: "Автотовары", 5541: "АЗС", 5542: "АЗС самообслуживания",
    5599: "Автоуслуги", 5611: "Мужская одежда", 5621: "Женская одежда", 5631: "Женские аксессуары",
    5641: "Детская одежда", 5651: "Одежда", 5661: "Обувь", 5691: "Одежда",
    5699: "Одежда и аксессуары", 5712: "Мебель", 5713: "Напольные покрытия", 5714: "Ткани",
    5719: "Товары для дома", 5722: "Бытовая техника", 5732: "Электроника", 5733: "Музыкальные товары",
    5734: "Компьютеры и ПО", 5735: "Музыка и медиа", 5811: "Кейтеринг", 5812: "Рестораны",
    5813: "Бары и клубы", 5814: "Фастфуд", 5912: "Аптеки", 5921: "Алкоголь",
    5931: "Секонд-хенд", 5932: "Антиквариат", 5941: "Спорттовары", 5942: "Книжные магазины",
    5943: "Канцелярские товары", 5944: "Ювелирные изделия", 5945: "Игрушки", 5946: "Фототовары",
    5947: "Подарки и сувениры", 5948: "Кожгалантерея", 5949: "Швейные товары", 5960: "Прямой маркетинг",
    5964: "Каталожные продажи", 5965: "Телемаркетинг", 5967: "Входящий телемаркетинг",
    5968: "Подписки", 5969: "Прямой маркетинг", 5970: "Товары для творчества", 5971: "Галереи",
    5977: "Косметика", 5992: "Цветы", 5993: "Табачные товары", 5994: "Газеты и журналы",
    5995: "Зоотовары", 5999: "Разные специализированные магазины", 6010: "Финансовые услуги кассы",
    6011: "Снятие наличных", 6012: "Финансовые услуги", 6051: "Денежные переводы",
    6211: "Брокеры и ценные бумаги", 7011: "Отели", 7210: "Прачечные", 7216: "Химчистки",
    7221: "Фотостудии", 7230: "Салоны красоты", 7273: "Знакомства", 7298: "Фитнес и здоровье",
    7299: "Персональные услуги", 7311: "Реклама", 7399: "Бизнес-услуги", 7512: "Аренда авто",
    7523: "Парковки", 7531: "Автосервис", 7534: "Шины", 7538: "Ремонт авто",
    7542: "Автомойки", 7629: "Ремонт техники", 7832: "Кинотеатры", 7841: "Видеопрокат",
    7911: "Танцевальные студии", 7922: "Театры и концерты", 7932: "Бильярд", 7933: "Боулинг",
    7991: "Туристические услуги", 7994: "Видеоигры", 7995: "Азартные игры", 7996: "Парки развлечений",
    7997: "Клубы", 7999: "Развлечения", 8011: "Врачи", 8021: "Стоматология",
    8043: "Оптика", 8062: "Больницы", 8099: "Медицина", 8211: "Школы", 8220: "Колледжи",
    8244: "Бизнес-образование", 8299: "Образование", 8999: "Профессиональные услуги", 9399: "Госуслуги",
}


@dataclass
class Settings:
    """What a run needs to know of a data set; see sources.files.load_settings."""

    name: str = "default"
    columns: dict[str, str] = field(default_factory=dict)
    label_names: dict[str, str] = field(default_factory=dict)
    category_label: str = "категории трат"
    churn_profile: bool = False
    splits: dict[str, str] = field(default_factory=dict)
    options: dict = field(default_factory=dict)

    @property
    def num_labels(self) -> int:
        return len(self.label_names)


def missing(df: DataFrame, needed: tuple[str, ...]) -> list[str]:
    return sorted(set(needed) - set(df.columns))


def require(df: DataFrame, needed: tuple[str, ...] = REQUIRED) -> DataFrame:
    """df, or ValueError naming the columns that it lacks."""
    if gone := missing(df, needed):
        raise ValueError(f"missing columns: {gone}; found: {df.columns}")
    return df


def rename_roles(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """Rename source columns (role -> source name) to the internal names, where they exist and differ."""
    internal = {"customer_id": "customer_id", "datetime": "tr_datetime", "amount": "amount", "category": "mcc_code_desc", "label": "label"}
    return df.withColumnsRenamed({source: internal[role] for role, source in columns.items() if source in df.columns and source != internal[role]})


def id_and_label(columns: list[str]) -> tuple[str, str]:
    """The id column (the first whose name holds "id") and the label column (the first other one) of a label table."""
    found = next((c for c in columns if "id" in c.lower()), columns[0])
    return found, next(c for c in columns if c != found)
