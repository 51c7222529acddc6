"""Fixed values the results depend on, kept as plain tables."""

# Share of each end use in total demand, per archetype key.
END_USES = ("heating", "cooling", "hot_water", "lighting", "ventilation")
END_USE_RATIOS = {
    "apartment": (0.42, 0.10, 0.28, 0.10, 0.10),
    "residential_single": (0.45, 0.08, 0.30, 0.08, 0.09),
    "office": (0.30, 0.25, 0.10, 0.20, 0.15),
    "retail": (0.22, 0.30, 0.05, 0.25, 0.18),
    "education": (0.38, 0.15, 0.15, 0.18, 0.14),
    "hospital": (0.32, 0.22, 0.20, 0.14, 0.12),
    "warehouse": (0.35, 0.12, 0.05, 0.30, 0.18),
    "cultural": (0.35, 0.18, 0.08, 0.22, 0.17),
    "mixed_use": (0.28, 0.22, 0.25, 0.14, 0.11),
    "apartment_district_heating": (0.32, 0.12, 0.28, 0.15, 0.13),
    "apartment_ondol": (0.42, 0.08, 0.30, 0.11, 0.09),
    "datacenter": (0.01, 0.75, 0.00, 0.10, 0.14),
    "mixed_residential_commercial": (0.34, 0.20, 0.20, 0.14, 0.12),
}
DEFAULT_END_USE = (0.35, 0.18, 0.18, 0.16, 0.13)

# The same shares chosen by a word contained in the register use name, first hit wins.
END_USE_BY_WORD = (
    ("아파트", (0.42, 0.10, 0.28, 0.10, 0.10)),
    ("공동주택", (0.42, 0.10, 0.28, 0.10, 0.10)),
    ("업무시설", (0.30, 0.25, 0.10, 0.20, 0.15)),
    ("판매시설", (0.22, 0.30, 0.05, 0.25, 0.18)),
    ("교육연구", (0.38, 0.15, 0.15, 0.18, 0.14)),
    ("의료시설", (0.32, 0.22, 0.20, 0.14, 0.12)),
)

# Archetype parameters when nothing matches.
DEFAULT_ARCHETYPE = {
    "wall_uvalue": 0.80, "roof_uvalue": 0.60, "window_uvalue": 3.40, "wwr": 0.35,
    "ref_heating": 80.0, "ref_cooling": 30.0, "ref_total": 160.0,
}

# Electricity / gas / district-heat share by use.
FUEL_MIX = {
    "apartment": (0.35, 0.65, 0.00),
    "residential_single": (0.30, 0.70, 0.00),
    "office": (0.80, 0.20, 0.00),
    "retail": (0.85, 0.15, 0.00),
    "education": (0.60, 0.40, 0.00),
    "hospital": (0.55, 0.35, 0.10),
    "warehouse": (0.60, 0.40, 0.00),
    "cultural": (0.70, 0.30, 0.00),
    "mixed_use": (0.65, 0.35, 0.00),
    "공동주택": (0.35, 0.65, 0.00),
    "단독주택": (0.30, 0.70, 0.00),
    "업무시설": (0.80, 0.20, 0.00),
    "제1종근린생활시설": (0.85, 0.15, 0.00),
    "제2종근린생활시설": (0.85, 0.15, 0.00),
    "판매시설": (0.85, 0.15, 0.00),
    "교육연구시설": (0.60, 0.40, 0.00),
    "의료시설": (0.55, 0.35, 0.10),
    "창고시설": (0.60, 0.40, 0.00),
    "공장": (0.60, 0.40, 0.00),
    "문화및집회시설": (0.70, 0.30, 0.00),
    "종교시설": (0.70, 0.30, 0.00),
    "노유자시설": (0.65, 0.35, 0.00),
}
DEFAULT_FUEL_MIX = (0.65, 0.35, 0.00)

# Emission (kgCO2/kWh) and primary-energy factors of electricity, gas, district heat.
CO2_FACTORS = (0.4781, 0.2036, 0.1218)
PRIMARY_FACTORS = (2.75, 1.1, 0.614)

# Calibration of simulated demand against metered demand, by register use name.
CORRECTION_FACTORS = {
    "공동주택": 0.8784, "지역난방공동주택": 0.7467, "지역난방아파트": 0.7467, "온돌주택": 0.8100,
    "교육연구시설": 0.5543, "근린생활시설": 0.4473, "노유자시설": 0.1481, "문화및집회시설": 0.4523,
    "숙박시설": 1.0, "업무시설": 0.2934, "제1종근린생활시설": 0.4533, "제2종근린생활시설": 0.4303, "종교시설": 1.0,
}

# Archetype key -> simulated archetype.
SIMULATED_ARCHETYPE = {
    "apartment": "apartment_highrise", "residential_single": "apartment_midrise", "office": "office",
    "retail": "small_office", "education": "school", "hospital": "hospital", "warehouse": "warehouse",
    "cultural": "retail", "mixed_use": "hotel", "apartment_district_heating": "apartment_highrise",
    "apartment_ondol": "apartment_midrise", "datacenter": "warehouse",
    "mixed_residential_commercial": "small_office",
}

# Register use name -> simulated archetype when calibrating (null: cannot be calibrated).
CALIBRATION_ARCHETYPE = {
    "제1종근린생활시설": "small_office", "제2종근린생활시설": "small_office", "근린생활시설": "small_office",
    "업무시설": "office", "교육연구시설": "school", "의료시설": "hospital", "노유자시설": "hospital",
    "공동주택": "apartment_midrise", "아파트": "apartment_highrise",
    "문화및집회시설": "retail", "판매시설": "retail", "창고시설": "warehouse",
}
CALIBRATION_CITIES = ("seoul", "busan", "daegu", "gangneung", "jeju")

# Simulated archetype -> simulated building type of the city medians.
ARCHETYPE_BUILDING = {
    "apartment_highrise": "Apartment", "apartment_midrise": "Apartment", "hospital": "Hospital", "hotel": "Hotel",
    "office": "LargeOffice", "retail": "Retail", "school": "School", "small_office": "SmallOffice",
    "strip_mall": "RetailStripmall", "university": "School", "warehouse": "Warehouse",
}

# Floor area (m2) of the simulated building types.
SIMULATED_AREA = {
    "Hotel": 11345.0, "MediumOffice": 4982.0, "LargeOffice": 46320.0, "School": 19592.0, "Retail": 2294.0,
    "Restaurant": 232.0, "Warehouse": 4835.0, "Apartment": 3135.0, "SmallOffice": 511.0,
    "FullServiceRestaurant": 511.0, "RetailStripmall": 2090.0, "PrimarySchool": 6871.0, "SmallHotel": 4014.0,
    "Hospital": 22422.0, "OutPatient": 3804.0,
}
JOULES_PER_KWH = 3_600_000.0

# Floor area (m2) of the simulated archetypes.
ARCHETYPE_AREA = {
    "apartment_highrise": 17471.0, "apartment_midrise": 3135.0, "office": 4982.0, "school": 6871.0,
    "university": 6871.0, "retail": 2294.0, "hospital": 22422.0, "hotel": 4013.0, "small_office": 511.0,
    "large_office": 46320.0, "warehouse": 4835.0, "restaurant_full": 511.0, "restaurant_quick": 232.0,
    "strip_mall": 2090.0,
}

# District prefix -> simulated city; every other district counts as seoul.
CITY_BY_PREFIX = {
    "11": "seoul", "28": "incheon", "26": "busan", "27": "daegu", "29": "gwangju", "30": "daejeon", "31": "ulsan",
    "50": "jeju", "43110": "cheongju", "43111": "cheongju", "43112": "cheongju", "43113": "cheongju",
    "43114": "cheongju", "51150": "gangneung", "42150": "gangneung",
}

# Efficiency grade -> primary EUI (kWh/m2/yr), and other spellings of a grade.
GRADE_EUI = {
    "1+++": 45.0, "1++": 75.0, "1+": 105.0, "1": 135.0, "2": 170.0,
    "3": 210.0, "4": 250.0, "5": 295.0, "6": 345.0, "7": 420.0,
}
GRADE_ALIASES = {
    "1+++등급": "1+++", "1++등급": "1++", "1+등급": "1+", "1등급": "1", "2등급": "2", "3등급": "3",
    "4등급": "4", "5등급": "5", "6등급": "6", "7등급": "7", "A": "1+++", "B": "1++", "C": "1+",
}

# Data tier of an energy source.
SOURCE_TIER = {
    "bldg_energy_hub": 1, "kea_cert": 2, "energy_grade": 2, "seoul_green_cert": 2, "energyplus": 3, "archetype": 4,
}

ZEB_THRESHOLD = 150.0

# Retrofit measures in application order; savings per vintage class plus a default.
VINTAGES = ("pre-1980", "1980-2000", "2001-2010", "post-2010")
RETROFIT = (
    # id, label, cost per m2 of floor, then heating / cooling / lighting savings by vintage + default
    ("window", "창호 교체 (저방사 이중창 → 삼중창)", 35_000,
     (0.22, 0.18, 0.10, 0.05, 0.12), (0.08, 0.06, 0.04, 0.02, 0.05), None),
    ("wall_insulation", "외벽 단열 강화 (외단열 추가 시공)", 45_000,
     (0.20, 0.15, 0.08, 0.03, 0.11), (0.05, 0.04, 0.02, 0.01, 0.03), None),
    ("roof_insulation", "지붕·옥상 단열 강화", 20_000,
     (0.12, 0.09, 0.05, 0.02, 0.07), (0.05, 0.04, 0.02, 0.01, 0.03), None),
    ("led_lighting", "LED 조명 전면 교체", 18_000, None, None, (0.55, 0.50, 0.40, 0.20, 0.40)),
    ("hvac_upgrade", "고효율 냉난방설비 교체 (EHP/GHP)", 65_000,
     (0.25, 0.20, 0.12, 0.05, 0.15), (0.25, 0.20, 0.12, 0.05, 0.15), None),
)
# Share of heating, cooling and lighting in the whole, for retrofit savings.
RETROFIT_SHARES = (0.45, 0.20, 0.15)
# KRW per kWh of electricity and gas, and the electricity share priced per use.
PRICES = (120.0, 80.0)
PRICE_ELEC_SHARE = {
    "공동주택": 0.35, "단독주택": 0.30, "업무시설": 0.80, "제1종근린생활시설": 0.85, "제2종근린생활시설": 0.85,
    "판매시설": 0.85, "교육연구시설": 0.60, "의료시설": 0.55, "창고시설": 0.60, "공장": 0.60,
    "문화및집회시설": 0.70, "종교시설": 0.70,
}
DEFAULT_PRICE_ELEC_SHARE = 0.65

# Typical weather of a month: heating and cooling degree days, radiation, mean temperature.
MONTHLY_WEATHER = {
    1: (529.0, 0.0, 3.1, -2.4), 2: (390.0, 0.0, 4.0, 0.4), 3: (195.0, 0.0, 4.9, 5.6), 4: (30.0, 0.0, 5.5, 12.5),
    5: (0.0, 0.0, 5.8, 18.0), 6: (0.0, 12.0, 5.2, 22.6), 7: (0.0, 93.0, 4.5, 25.7), 8: (0.0, 91.0, 4.8, 26.4),
    9: (0.0, 3.0, 4.9, 21.3), 10: (45.0, 0.0, 4.1, 14.5), 11: (225.0, 0.0, 3.2, 7.0), 12: (450.0, 0.0, 2.8, 0.3),
}
ANNUAL_WEATHER = (
    sum(v[0] for v in MONTHLY_WEATHER.values()),
    sum(v[1] for v in MONTHLY_WEATHER.values()),
    sum(v[2] for v in MONTHLY_WEATHER.values()) / 12,
    sum(v[3] for v in MONTHLY_WEATHER.values()) / 12,
)

# Public holidays known to the calendar features.
HOLIDAYS = (
    "2025-01-01", "2025-01-28", "2025-01-29", "2025-01-30", "2025-03-01", "2025-05-05", "2025-05-06", "2025-06-06",
    "2025-08-15", "2025-10-03", "2025-10-05", "2025-10-06", "2025-10-07", "2025-10-09", "2025-12-25",
    "2026-01-01", "2026-02-16", "2026-02-17", "2026-02-18", "2026-03-01", "2026-05-05", "2026-06-06", "2026-08-15",
    "2026-09-24", "2026-09-25", "2026-09-26", "2026-10-03", "2026-10-09", "2026-12-25",
)

# Feature encodings and primary-to-final conversion of certified demand.
USAGE_CODES = {
    "apartment": 0, "residential_single": 1, "office": 2, "retail": 3, "education": 4,
    "hospital": 5, "warehouse": 6, "cultural": 7, "mixed_use": 8,
}
VINTAGE_CODES = {"pre-1980": 0, "1980-2000": 1, "2001-2010": 2, "post-2010": 3}
STRUCTURE_CODES = {"RC": 0, "steel": 1, "masonry": 2}
PRIMARY_TO_FINAL = {
    "apartment": 0.62, "residential_single": 0.60, "office": 0.45, "retail": 0.42, "education": 0.55,
    "hospital": 0.48, "warehouse": 0.52, "cultural": 0.53, "mixed_use": 0.50,
}
DEFAULT_PRIMARY_TO_FINAL = 0.50
FEATURES = (
    "wall_uvalue", "roof_uvalue", "window_uvalue", "wwr", "ref_heating", "ref_cooling",
    "vintage_class_enc", "usage_type_enc", "structure_type_enc", "total_area_log", "floors", "built_year_age",
    "HDD18_annual", "CDD24_annual", "solar_rad_avg", "avg_temp_annual",
    "wall_uvalue_x_HDD18", "window_uvalue_x_CDD24", "area_x_usage",
)
LAGS = (1, 2, 3, 7, 14, 30)
ROLLING = (7, 14, 30)

# Compass point -> degrees, wind level -> m/s.
COMPASS = {
    "N": 0.0, "NNE": 22.5, "NE": 45.0, "ENE": 67.5, "E": 90.0, "ESE": 112.5, "SE": 135.0, "SSE": 157.5,
    "S": 180.0, "SSW": 202.5, "SW": 225.0, "WSW": 247.5, "W": 270.0, "WNW": 292.5, "NW": 315.0, "NNW": 337.5,
}
WIND_LEVEL = {0: 0.0, 1: 2.0, 2: 5.0, 3: 9.0, 4: 13.0}
DEFAULT_WIND_SPEED = 2.0

# District fire stations.
STATIONS = (
    ("종로소방서", "종로구", 126.9784, 37.5760), ("중부소방서", "중구", 126.9979, 37.5636),
    ("용산소방서", "용산구", 126.9882, 37.5326), ("성동소방서", "성동구", 127.0422, 37.5637),
    ("광진소방서", "광진구", 127.0898, 37.5540), ("동대문소방서", "동대문구", 127.0400, 37.5741),
    ("중랑소방서", "중랑구", 127.0923, 37.6052), ("성북소방서", "성북구", 127.0167, 37.6052),
    ("강북소방서", "강북구", 127.0281, 37.6390), ("도봉소방서", "도봉구", 127.0474, 37.6693),
    ("노원소방서", "노원구", 127.0771, 37.6548), ("은평소방서", "은평구", 126.9334, 37.6217),
    ("서대문소방서", "서대문구", 126.9360, 37.5787), ("마포소방서", "마포구", 126.9087, 37.5574),
    ("양천소방서", "양천구", 126.8686, 37.5145), ("강서소방서", "강서구", 126.8341, 37.5554),
    ("구로소방서", "구로구", 126.8875, 37.4948), ("금천소방서", "금천구", 126.8942, 37.4568),
    ("영등포소방서", "영등포구", 126.9082, 37.5264), ("동작소방서", "동작구", 126.9440, 37.4987),
    ("관악소방서", "관악구", 126.9531, 37.4745), ("서초소방서", "서초구", 127.0000, 37.4867),
    ("강남소방서", "강남구", 127.0551, 37.5104), ("송파소방서", "송파구", 127.1070, 37.5051),
    ("강동소방서", "강동구", 127.1477, 37.5547),
)

# Shelters used when no shelter feed is at hand.
SHELTERS = [
    ("서울광장", "광장", 50000, 126.9780, 37.5662), ("여의도공원", "공원", 30000, 126.9249, 37.5259),
    ("올림픽공원", "공원", 80000, 127.1219, 37.5205), ("남산공원", "공원", 20000, 126.9900, 37.5513),
    ("월드컵공원", "공원", 50000, 126.8879, 37.5679), ("북서울꿈의숲", "공원", 15000, 127.0468, 37.6296),
    ("용산가족공원", "공원", 10000, 126.9784, 37.5252), ("서울대공원", "공원", 40000, 127.0107, 37.4314),
    ("보라매공원", "공원", 20000, 126.9218, 37.4943), ("중랑캠핑숲", "공원", 5000, 127.0997, 37.6274),
    ("마포구민체육관", "체육관", 3000, 126.9028, 37.5607), ("강남구민체육관", "체육관", 3000, 127.0477, 37.5040),
    ("노원구민체육관", "체육관", 3000, 127.0604, 37.6544), ("은평구민체육관", "체육관", 3000, 126.9287, 37.6177),
    ("송파구민체육관", "체육관", 3000, 127.1116, 37.5145), ("종로구민체육관", "체육관", 3000, 126.9827, 37.5940),
    ("중구민체육관", "체육관", 3000, 126.9977, 37.5636), ("용산구민체육관", "체육관", 3000, 126.9884, 37.5340),
    ("성동구민체육관", "체육관", 3000, 127.0374, 37.5631), ("광진구민체육관", "체육관", 3000, 127.0820, 37.5389),
    ("동대문구민체육관", "체육관", 3000, 127.0543, 37.5745), ("중랑구민체육관", "체육관", 3000, 127.0926, 37.6065),
    ("성북구민체육관", "체육관", 3000, 127.0170, 37.6050), ("강북구민체육관", "체육관", 3000, 127.0251, 37.6396),
    ("도봉구민체육관", "체육관", 3000, 127.0469, 37.6686), ("서대문구민체육관", "체육관", 3000, 126.9368, 37.5793),
    ("양천구민체육관", "체육관", 3000, 126.8662, 37.5249), ("강서구민체육관", "체육관", 3000, 126.8500, 37.5545),
    ("구로구민체육관", "체육관", 3000, 126.8878, 37.4954), ("금천구민체육관", "체육관", 3000, 126.8955, 37.4567),
    ("영등포구민체육관", "체육관", 3000, 126.9063, 37.5261), ("동작구민체육관", "체육관", 3000, 126.9399, 37.4970),
    ("관악구민체육관", "체육관", 3000, 126.9514, 37.4769), ("서초구민체육관", "체육관", 3000, 127.0325, 37.4836),
    ("강동구민체육관", "체육관", 3000, 127.1467, 37.5496),
]

# Reference rows of the data source registry.
DATA_SOURCES = [
    ("bldg_energy_hub_elec", 1, "measured", "monthly"), ("bldg_energy_hub_gas", 1, "measured", "monthly"),
    ("energy_grade_cert", 2, "certified", "annual"), ("seoul_open_data", 2, "certified", "annual"),
    ("energyplus_sim", 3, "simulation", "on_demand"), ("ml_prediction", 3, "prediction", "on_demand"),
    ("archetype_lookup", 4, "lookup", "on_demand"), ("tier_c_metered", 1, "measured", "continuous"),
]
