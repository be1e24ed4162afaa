"""Fixed values shared with other implementations of the same record formats."""

# Sample types, (code, name, observed property key).
SAMPLE_TYPES = [
    (1, "AmbientAirTemperature", "temperature_air"),
    (2, "AmbientRelativeHumidity", "relative_humidity"),
    (3, "InterfaceTemperature", "temperature_interface"),
    (4, "CoverageCapacitance", "coverage_capacitance"),
    (5, "BioImpedanceMagnitude", "bioimpedance_magnitude"),
    (6, "BioImpedanceActivity", "bioimpedance_activity"),
    (7, "SupplyVoltage", "supply_voltage"),
    (8, "BatterySoc", "battery_soc"),
    (9, "FloodContact", "flood_contact"),
    (10, "LinkQuality", "link_quality"),
    (11, "WaterLevel", "water_level"),
    (12, "WaterFlowRate", "water_flow_rate"),
    (13, "WaterVolume", "water_volume"),
    (14, "WaterPressure", "water_pressure"),
    (15, "WaterTemperature", "water_temperature"),
    (16, "WaterElectricalConductivity", "water_electrical_conductivity"),
    (17, "WaterPh", "water_ph"),
    (18, "WaterDissolvedOxygen", "water_dissolved_oxygen"),
    (19, "WaterTurbidity", "water_turbidity"),
    (20, "WaterSalinity", "water_salinity"),
    (21, "WaterTotalDissolvedSolids", "water_total_dissolved_solids"),
    (22, "Rainfall", "rainfall"),
    (23, "RainIntensity", "rain_intensity"),
    (24, "WindSpeed", "wind_speed"),
    (25, "WindDirection", "wind_direction"),
    (26, "BarometricPressure", "barometric_pressure"),
    (27, "SolarIrradiance", "solar_irradiance"),
    (28, "SoilMoisture", "soil_moisture"),
    (29, "SoilTemperature", "soil_temperature"),
    (30, "SoilElectricalConductivity", "soil_electrical_conductivity"),
    (31, "VibrationRms", "vibration_rms"),
    (32, "VibrationPeak", "vibration_peak"),
    (33, "ShockAcceleration", "shock_acceleration"),
    (34, "InclinationAngle", "inclination_angle"),
    (35, "Displacement", "displacement"),
    (36, "Strain", "strain"),
    (37, "CrackWidth", "crack_width"),
    (38, "AcousticNoise", "acoustic_noise"),
    (39, "AirQualityPm25", "air_quality_pm25"),
    (40, "AirQualityPm10", "air_quality_pm10"),
    (41, "CarbonDioxide", "carbon_dioxide"),
    (42, "VolatileOrganicCompounds", "volatile_organic_compounds"),
    (43, "BatteryVoltage", "battery_voltage"),
    (44, "BatteryCurrent", "battery_current"),
    (45, "BatteryTemperature", "battery_temperature"),
    (46, "SolarChargeCurrent", "solar_charge_current"),
    (47, "EnclosureHumidity", "enclosure_humidity"),
    (48, "EnclosureTemperature", "enclosure_temperature"),
    (49, "RadioRssi", "radio_rssi"),
    (50, "RadioSnr", "radio_snr"),
    (250, "Custom", "custom"),
]

# Fact kinds.
FACT_KINDS = [
    (1, "env.sample"),
    (2, "pipeline.event"),
    (3, "health.status"),
    (250, "custom.raw"),
]

# Rejection audit vocabularies.
REJECTION_SOURCES = ["parse", "decrypt", "replay"]
REJECTION_REASONS = [
    "line_too_long", "invalid_json", "not_dict",
    "missing_frame_fields", "unexpected_frame_fields", "invalid_hdr",
    "invalid_frame_types", "missing_hdr_fields", "unexpected_hdr_fields",
    "invalid_hdr_types", "dev_id_range", "msg_type_range", "fc_range",
    "flags_range", "invalid_ingest_profile", "unsupported_flags",
    "unknown_device", "missing_salt8", "invalid_base64", "salt8_length",
    "ck_up_length", "nonce_length", "tag_length", "empty_ciphertext",
    "ciphertext_too_large", "nonce_salt_mismatch", "nonce_fc_mismatch",
    "decrypt_failed", "payload_device_id_mismatch", "payload_fc_mismatch",
    "duplicate", "out_of_window", "continuity_break", "resync_required",
]

# Segment close reasons, lowest precedence first.
CLOSE_REASONS = [
    (1, "manual"),
    (2, "interval"),
    (3, "record_limit"),
    (4, "size_limit"),
    (5, "reconfigure"),
    (6, "shutdown"),
    (7, "recovery"),
]

# Limits and identifiers of the record formats.
INGEST_PROFILE = "rust-postcard-v1"
MAX_CIPHERTEXT = 256
REPLAY_WINDOW = 64
PROFILE_V1 = "verifiable-telemetry-canonical-cbor-v1"
PROFILE_V2 = "verifiable-telemetry-canonical-cbor-v2"
ZERO_SHA256 = "0" * 64
EMPTY_SHA256 = "e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855"

# Disclosure classes and their labels.
DISCLOSURE_LABELS = [
    ("A", "public-recompute"),
    ("B", "partner-audit"),
    ("C", "anchor-only-evidence"),
]

# Anchoring states and their rank.
ANCHOR_STATES = [
    ("failed", -1),
    ("stationary", 0),
    ("calendar-pending", 1),
    ("bitcoin-attested-structure", 2),
    ("bitcoin-header-quorum-verified", 3),
]
