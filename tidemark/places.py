"""The registry of named places that a map may show as points. Fixed values, in the order in which aliases are tried."""

from __future__ import annotations

#: place, name, latitude, longitude, taluk, administrative level
REGISTRY = [
    ("anna_nagar", "Anna Nagar Uzhavar Santhai", 9.9179, 78.1504, "Madurai East", "Corporation Ward / East Zone"),
    ("chokkikulam", "Chokkikulam Uzhavar Santhai", 9.9363, 78.1384, "Madurai North", "Corporation Ward / North Zone"),
    ("palanganatham", "Palanganatham Uzhavar Santhai", 9.9042, 78.0967, "Madurai South", "Corporation Ward / South Zone"),
    ("usilampatti", "Usilampatti Uzhavar Santhai", 9.9701, 77.7928, "Usilampatti", "Usilampatti Municipality"),
    ("thirumangalam", "Thirumangalam Uzhavar Santhai", 9.8237, 77.9894, "Thirumangalam", "Thirumangalam Municipality"),
    ("melur", "Melur Uzhavar Santhai", 10.0347, 78.3370, "Melur", "Melur Municipality"),
    ("anaiyur", "Anaiyur Uzhavar Santhai", 9.9632, 78.1065, "Madurai North", "Anaiyur Urban Zone"),
    ("imd_madurai", "IMD Meteorological Observatory (Station 43360)", 9.8344, 78.0934, "Thiruparankundram", "Madurai Airport Sector"),
    ("madurai_corporation", "Madurai Municipal Corporation HQ (Anna Maligai)", 9.9272, 78.1215, "Madurai North", "Tallakulam Civic Central"),
    ("thiruvathavur", "Thiruvathavur Primary Health Centre", 10.0163, 78.3182, "Melur", "Thiruvathavur Revenue Village"),
    ("thirupparankundram", "Thirupparankundram Hill & Shrine Precinct", 9.8821, 78.0734, "Thiruparankundram", "Heritage Zone"),
    ("nagamalai_pudukkottai", "Nagamalai Pudukkottai (NGO Colony)", 9.9238, 78.0416, "Madurai West", "Nagamalai Panchayat"),
    ("melur_highway", "Melur National Highway Corridor", 10.0347, 78.3370, "Melur", "NH-38 Safety Inspection Sector"),
    ("sholavandan", "Sholavandan Agricultural Demonstration Farm", 10.0219, 78.0076, "Vadipatti", "Sholavandan Town Panchayat"),
]
ALIASES = {
    "anna_nagar": ["anna nagar", "அண்ணா நகர்"],
    "chokkikulam": ["chokkikulam", "சொக்கிகுளம்"],
    "palanganatham": ["palanganatham", "பழங்காநத்தம்"],
    "usilampatti": ["usilampatti", "உசிலம்பட்டி"],
    "thirumangalam": ["thirumangalam", "திருமங்கலம்"],
    "melur": ["melur", "மேலூர்", "மேலுார்"],
    "anaiyur": ["anaiyur", "ஆனையூர்", "அனையூர்"],
    "thiruvathavur": ["thiruvathavur", "திருவாதவூர்"],
    "thirupparankundram": ["thirupparankundram", "thiruparankundram", "திருப்பரங்குன்றம்"],
    "nagamalai_pudukkottai": ["nagamalai pudukkottai", "nagamalai", "நாகமலை"],
    "melur_highway": ["melur national highway", "melur highway", "மேலூர் நெடுஞ்சாலை"],
    "sholavandan": ["sholavandan", "சோழவந்தான்"],
    "madurai_corporation": ["madurai municipal corporation hq", "anna maligai"],
}
STATION, STATION_SOURCE, STATION_PLACE = "43360", "imd_city_madurai", "imd_madurai"
DISTRICT_ALIASES = ["madurai", "மதுரை"]
#: Latitudes and longitudes of the district: a pair that lies in them the wrong way round was swapped.
LATITUDES, LONGITUDES = (9.55, 10.35), (77.65, 78.55)
