"""Fixed lookup values. They decide results, so they are stated as plain text."""

# Country -> time zone, policy "country" (trips, recent list).
COUNTRY_TZ = {
    'Belarus': 'Europe/Minsk',
    'Moldova': 'Europe/Chisinau',
    'Poland': 'Europe/Warsaw',
    'Ukraine': 'Europe/Kyiv',
    'Italy': 'Europe/Rome',
    'Romania': 'Europe/Bucharest',
    'Lithuania': 'Europe/Vilnius',
    'Germany': 'Europe/Berlin',
    'Türkiye': 'Europe/Istanbul',
    'Turkey': 'Europe/Istanbul',
    'China': 'Asia/Shanghai',
    'Spain': 'Europe/Madrid',
    'Georgia': 'Asia/Tbilisi',
    'France': 'Europe/Paris',
    'India': 'Asia/Kolkata',
    'Latvia': 'Europe/Riga',
    'Portugal': 'Europe/Lisbon',
    'Iran': 'Asia/Tehran',
    'Egypt': 'Africa/Cairo',
    'Japan': 'Asia/Tokyo',
    'United Kingdom': 'Europe/London',
    'Czechia': 'Europe/Prague',
    'Czech Republic': 'Europe/Prague',
    'Hungary': 'Europe/Budapest',
    'Austria': 'Europe/Vienna',
    'Switzerland': 'Europe/Zurich',
    'Netherlands': 'Europe/Amsterdam',
    'Belgium': 'Europe/Brussels',
    'Slovakia': 'Europe/Bratislava',
    'Bulgaria': 'Europe/Sofia',
    'Greece': 'Europe/Athens',
    'Croatia': 'Europe/Zagreb',
    'Serbia': 'Europe/Belgrade',
    'Estonia': 'Europe/Tallinn',
    'Finland': 'Europe/Helsinki',
    'Sweden': 'Europe/Stockholm',
    'Norway': 'Europe/Oslo',
    'Denmark': 'Europe/Copenhagen',
    'Kazakhstan': 'Asia/Almaty',
    'Uzbekistan': 'Asia/Tashkent',
    'Azerbaijan': 'Asia/Baku',
    'Armenia': 'Asia/Yerevan',
    'Israel': 'Asia/Jerusalem',
    'Jordan': 'Asia/Amman',
    'Thailand': 'Asia/Bangkok',
    'Vietnam': 'Asia/Ho_Chi_Minh',
    'Indonesia': 'Asia/Jakarta',
    'South Korea': 'Asia/Seoul',
    'Taiwan': 'Asia/Taipei',
    'Singapore': 'Asia/Singapore',
    'Malaysia': 'Asia/Kuala_Lumpur',
    'Pakistan': 'Asia/Karachi',
    'Nepal': 'Asia/Kathmandu',
    'Mongolia': 'Asia/Ulaanbaatar',
    'Morocco': 'Africa/Casablanca',
    'Tunisia': 'Africa/Tunis',
    'South Africa': 'Africa/Johannesburg',
    'New Zealand': 'Pacific/Auckland',
    'Holy See (Vatican City State)': 'Europe/Rome',
    'San Marino': 'Europe/Rome',
    'Monaco': 'Europe/Monaco',
    'Malta': 'Europe/Malta',
    'Cyprus': 'Asia/Nicosia',
    'Iceland': 'Atlantic/Reykjavik',
    'Ireland': 'Europe/Dublin',
    'Slovenia': 'Europe/Ljubljana',
    'North Macedonia': 'Europe/Skopje',
    'Albania': 'Europe/Tirane',
    'Montenegro': 'Europe/Podgorica',
    'Bosnia and Herzegovina': 'Europe/Sarajevo',
    'Kosovo': 'Europe/Belgrade',
    'Tajikistan': 'Asia/Dushanbe',
    'Kyrgyzstan': 'Asia/Bishkek',
    'Turkmenistan': 'Asia/Ashgabat',
    'Oman': 'Asia/Muscat',
    'Saudi Arabia': 'Asia/Riyadh',
    'United Arab Emirates': 'Asia/Dubai',
    'Qatar': 'Asia/Qatar',
    'Kuwait': 'Asia/Kuwait',
    'Bahrain': 'Asia/Bahrain',
    'Iraq': 'Asia/Baghdad',
    'Lebanon': 'Asia/Beirut',
    'Myanmar': 'Asia/Rangoon',
    'Cambodia': 'Asia/Phnom_Penh',
    'Philippines': 'Asia/Manila',
    'Bangladesh': 'Asia/Dhaka',
    'Sri Lanka': 'Asia/Colombo',
    'Chile': 'America/Santiago',
    'Argentina': 'America/Argentina/Buenos_Aires',
    'Uruguay': 'America/Montevideo',
    'Bolivia': 'America/La_Paz',
    'Peru': 'America/Lima',
    'Ecuador': 'America/Guayaquil',
    'Colombia': 'America/Bogota',
    'Venezuela': 'America/Caracas',
    'Panama': 'America/Panama',
    'Costa Rica': 'America/Costa_Rica',
    'Cuba': 'America/Havana',
    'Jamaica': 'America/Jamaica',
}

# Country -> time zone, policy "bands" (feed).
FEED_TZ = {
    'Belarus': 'Europe/Minsk',
    'Moldova': 'Europe/Chisinau',
    'Poland': 'Europe/Warsaw',
    'Ukraine': 'Europe/Kyiv',
    'Italy': 'Europe/Rome',
    'Romania': 'Europe/Bucharest',
    'Lithuania': 'Europe/Vilnius',
    'Germany': 'Europe/Berlin',
    'Türkiye': 'Europe/Istanbul',
    'Turkey': 'Europe/Istanbul',
    'China': 'Asia/Shanghai',
    'Spain': 'Europe/Madrid',
    'Georgia': 'Asia/Tbilisi',
    'France': 'Europe/Paris',
    'India': 'Asia/Kolkata',
    'Latvia': 'Europe/Riga',
    'Portugal': 'Europe/Lisbon',
    'Iran': 'Asia/Tehran',
    'Egypt': 'Africa/Cairo',
    'Japan': 'Asia/Tokyo',
    'United Kingdom': 'Europe/London',
    'Czechia': 'Europe/Prague',
    'Czech Republic': 'Europe/Prague',
    'Hungary': 'Europe/Budapest',
    'Austria': 'Europe/Vienna',
    'Switzerland': 'Europe/Zurich',
    'Netherlands': 'Europe/Amsterdam',
    'Belgium': 'Europe/Brussels',
    'Slovakia': 'Europe/Bratislava',
    'Bulgaria': 'Europe/Sofia',
    'Greece': 'Europe/Athens',
    'Croatia': 'Europe/Zagreb',
    'Serbia': 'Europe/Belgrade',
    'Estonia': 'Europe/Tallinn',
    'Finland': 'Europe/Helsinki',
    'Sweden': 'Europe/Stockholm',
    'Norway': 'Europe/Oslo',
    'Denmark': 'Europe/Copenhagen',
    'Kazakhstan': 'Asia/Almaty',
    'Uzbekistan': 'Asia/Tashkent',
    'Azerbaijan': 'Asia/Baku',
    'Armenia': 'Asia/Yerevan',
    'Israel': 'Asia/Jerusalem',
    'Jordan': 'Asia/Amman',
    'Thailand': 'Asia/Bangkok',
    'Vietnam': 'Asia/Ho_Chi_Minh',
    'Indonesia': 'Asia/Jakarta',
    'South Korea': 'Asia/Seoul',
    'Taiwan': 'Asia/Taipei',
    'Singapore': 'Asia/Singapore',
    'Malaysia': 'Asia/Kuala_Lumpur',
    'Pakistan': 'Asia/Karachi',
    'Nepal': 'Asia/Kathmandu',
    'Mongolia': 'Asia/Ulaanbaatar',
    'Morocco': 'Africa/Casablanca',
    'Tunisia': 'Africa/Tunis',
    'South Africa': 'Africa/Johannesburg',
    'New Zealand': 'Pacific/Auckland',
    'Holy See (Vatican City State)': 'Europe/Rome',
    'San Marino': 'Europe/Rome',
    'Monaco': 'Europe/Monaco',
    'Malta': 'Europe/Malta',
    'Cyprus': 'Asia/Nicosia',
    'Iceland': 'Atlantic/Reykjavik',
    'Ireland': 'Europe/Dublin',
    'Slovenia': 'Europe/Ljubljana',
    'North Macedonia': 'Europe/Skopje',
    'Albania': 'Europe/Tirane',
    'Montenegro': 'Europe/Podgorica',
    'Bosnia and Herzegovina': 'Europe/Sarajevo',
    'Kosovo': 'Europe/Belgrade',
    'Tajikistan': 'Asia/Dushanbe',
    'Kyrgyzstan': 'Asia/Bishkek',
    'Turkmenistan': 'Asia/Ashgabat',
    'Qatar': 'Asia/Qatar',
    'UAE': 'Asia/Dubai',
    'United Arab Emirates': 'Asia/Dubai',
    'Saudi Arabia': 'Asia/Riyadh',
    'Iraq': 'Asia/Baghdad',
    'Lebanon': 'Asia/Beirut',
    'Hong Kong': 'Asia/Hong_Kong',
    'Macao': 'Asia/Macau',
    'Macau': 'Asia/Macau',
}

# Country name in the local language -> English.
COUNTRY_ENGLISH = {
    'Беларусь': 'Belarus',
    'Россия': 'Russia',
    'Україна': 'Ukraine',
    'Republica Moldova': 'Moldova',
    'Italia': 'Italy',
    'Polska': 'Poland',
    'România': 'Romania',
    'مصر': 'Egypt',
    'Lietuva': 'Lithuania',
    'Ўзбекістон': 'Uzbekistan',
    'Ўзбекистон': 'Uzbekistan',
    'Հայաստան': 'Armenia',
    'Κύπρος': 'Cyprus',
    'Ελλάδα': 'Greece',
    'Қазақстан': 'Kazakhstan',
    'Türkiye': 'Turkey',
    'Србија': 'Serbia',
    'Latvija': 'Latvia',
    'Magyarország': 'Hungary',
    'Hrvatska': 'Croatia',
    'Deutschland': 'Germany',
    'España': 'Spain',
    'Danmark': 'Denmark',
    'საქართველო': 'Georgia',
    'Sverige': 'Sweden',
    'Suomi': 'Finland',
    'Norge': 'Norway',
    'Česká republika': 'Czech Republic',
    'Österreich': 'Austria',
    'България': 'Bulgaria',
    'Bosna i Hercegovina': 'Bosnia and Herzegovina',
    'Slovenija': 'Slovenia',
    'Slovensko': 'Slovakia',
    'Кыргызстан': 'Kyrgyzstan',
    'Severna Makedonija': 'North Macedonia',
    'Eesti': 'Estonia',
    'ایران': 'Iran',
    'Việt Nam': 'Vietnam',
}

# Country -> two-letter code.
COUNTRY_ISO2 = {
    'Afghanistan': 'af',
    'Albania': 'al',
    'Algeria': 'dz',
    'Angola': 'ao',
    'Argentina': 'ar',
    'Armenia': 'am',
    'Australia': 'au',
    'Austria': 'at',
    'Azerbaijan': 'az',
    'Belarus': 'by',
    'Belgium': 'be',
    'Bolivia': 'bo',
    'Bosnia and Herzegovina': 'ba',
    'Brazil': 'br',
    'Bulgaria': 'bg',
    'Cambodia': 'kh',
    'Canada': 'ca',
    'Chile': 'cl',
    'China': 'cn',
    'Colombia': 'co',
    'Croatia': 'hr',
    'Cyprus': 'cy',
    'Czech Republic': 'cz',
    'Denmark': 'dk',
    'Ecuador': 'ec',
    'Egypt': 'eg',
    'Estonia': 'ee',
    'Finland': 'fi',
    'France': 'fr',
    'Georgia': 'ge',
    'Germany': 'de',
    'Greece': 'gr',
    'Hungary': 'hu',
    'Hong Kong': 'hk',
    'India': 'in',
    'Indonesia': 'id',
    'Iran': 'ir',
    'Iraq': 'iq',
    'Ireland': 'ie',
    'Israel': 'il',
    'Italy': 'it',
    'Japan': 'jp',
    'Kazakhstan': 'kz',
    'Kosovo': 'xk',
    'Kyrgyzstan': 'kg',
    'Latvia': 'lv',
    'Lithuania': 'lt',
    'Luxembourg': 'lu',
    'Macao': 'mo',
    'Malaysia': 'my',
    'Malta': 'mt',
    'Mexico': 'mx',
    'Moldova': 'md',
    'Montenegro': 'me',
    'Morocco': 'ma',
    'Myanmar': 'mm',
    'Netherlands': 'nl',
    'New Zealand': 'nz',
    'North Macedonia': 'mk',
    'Norway': 'no',
    'Oman': 'om',
    'Pakistan': 'pk',
    'Peru': 'pe',
    'Philippines': 'ph',
    'Poland': 'pl',
    'Portugal': 'pt',
    'Qatar': 'qa',
    'Romania': 'ro',
    'Russia': 'ru',
    'Serbia': 'rs',
    'Singapore': 'sg',
    'Slovakia': 'sk',
    'Slovenia': 'si',
    'South Korea': 'kr',
    'Spain': 'es',
    'Sweden': 'se',
    'Switzerland': 'ch',
    'Taiwan': 'tw',
    'Thailand': 'th',
    'Tunisia': 'tn',
    'Turkey': 'tr',
    'Türkiye': 'tr',
    'Ukraine': 'ua',
    'United Arab Emirates': 'ae',
    'United Kingdom': 'gb',
    'United States': 'us',
    'Uruguay': 'uy',
    'Uzbekistan': 'uz',
    'Venezuela': 've',
    'Vietnam': 'vn',
    'Holy See (Vatican City State)': 'va',
    '\tHoly See (Vatican City State)': 'va',
    'Vatican City': 'va',
    'North Korea': 'kp',
    'Cuba': 'cu',
    'Iceland': 'is',
    'Sri Lanka': 'lk',
    'Liechtenstein': 'li',
}

# Country -> continent code.
COUNTRY_CONTINENT = {
    'Belarus': 'EU',
    'Moldova': 'EU',
    'Poland': 'EU',
    'Ukraine': 'EU',
    'Italy': 'EU',
    'Romania': 'EU',
    'Lithuania': 'EU',
    'Germany': 'EU',
    'Türkiye': 'EU',
    'Turkey': 'EU',
    'Spain': 'EU',
    'France': 'EU',
    'Latvia': 'EU',
    'Portugal': 'EU',
    'United Kingdom': 'EU',
    'Czechia': 'EU',
    'Czech Republic': 'EU',
    'Hungary': 'EU',
    'Austria': 'EU',
    'Switzerland': 'EU',
    'Netherlands': 'EU',
    'Belgium': 'EU',
    'Slovakia': 'EU',
    'Bulgaria': 'EU',
    'Greece': 'EU',
    'Croatia': 'EU',
    'Serbia': 'EU',
    'Estonia': 'EU',
    'Finland': 'EU',
    'Sweden': 'EU',
    'Norway': 'EU',
    'Denmark': 'EU',
    'Iceland': 'EU',
    'Ireland': 'EU',
    'Slovenia': 'EU',
    'North Macedonia': 'EU',
    'Albania': 'EU',
    'Montenegro': 'EU',
    'Bosnia and Herzegovina': 'EU',
    'Kosovo': 'EU',
    'Malta': 'EU',
    'Holy See (Vatican City State)': 'EU',
    'San Marino': 'EU',
    'Monaco': 'EU',
    'Andorra': 'EU',
    'Luxembourg': 'EU',
    'Liechtenstein': 'EU',
    'Georgia': 'AS',
    'China': 'AS',
    'India': 'AS',
    'Japan': 'AS',
    'South Korea': 'AS',
    'Taiwan': 'AS',
    'Singapore': 'AS',
    'Malaysia': 'AS',
    'Thailand': 'AS',
    'Vietnam': 'AS',
    'Indonesia': 'AS',
    'Philippines': 'AS',
    'Myanmar': 'AS',
    'Cambodia': 'AS',
    'Bangladesh': 'AS',
    'Pakistan': 'AS',
    'Nepal': 'AS',
    'Sri Lanka': 'AS',
    'Kazakhstan': 'AS',
    'Uzbekistan': 'AS',
    'Tajikistan': 'AS',
    'Kyrgyzstan': 'AS',
    'Turkmenistan': 'AS',
    'Azerbaijan': 'AS',
    'Armenia': 'AS',
    'Israel': 'AS',
    'Jordan': 'AS',
    'Lebanon': 'AS',
    'Iraq': 'AS',
    'Iran': 'AS',
    'Oman': 'AS',
    'Saudi Arabia': 'AS',
    'United Arab Emirates': 'AS',
    'Qatar': 'AS',
    'Kuwait': 'AS',
    'Bahrain': 'AS',
    'Yemen': 'AS',
    'Cyprus': 'EU',
    'Mongolia': 'AS',
    'Hong Kong': 'AS',
    'Morocco': 'AF',
    'Tunisia': 'AF',
    'Egypt': 'AF',
    'Libya': 'AF',
    'Algeria': 'AF',
    'Sudan': 'AF',
    'Ethiopia': 'AF',
    'Kenya': 'AF',
    'Tanzania': 'AF',
    'South Africa': 'AF',
    'Nigeria': 'AF',
    'Ghana': 'AF',
    'Senegal': 'AF',
    'Ivory Coast': 'AF',
    'Russia': 'EU',
    'United States': 'NA',
    'Canada': 'NA',
    'Mexico': 'NA',
    'Cuba': 'NA',
    'Jamaica': 'NA',
    'Dominican Republic': 'NA',
    'Puerto Rico': 'NA',
    'Brazil': 'SA',
    'Argentina': 'SA',
    'Chile': 'SA',
    'Colombia': 'SA',
    'Peru': 'SA',
    'Venezuela': 'SA',
    'Ecuador': 'SA',
    'Bolivia': 'SA',
    'Uruguay': 'SA',
    'Paraguay': 'SA',
    'New Zealand': 'OC',
    'Australia': 'OC',
    'Fiji': 'OC',
    'Papua New Guinea': 'OC',
}

# World-city name -> other spellings, in order of preference (overview list).
CITY_ALIASES = {
    'Chisinau': ['Chișinău', 'Chisinau'],
    'Kishinev': ['Chișinău'],
    'Iasi': ['Iași'],
    'Constanta': ['Constanța'],
    'Brasov': ['Brașov'],
    'Balti': ['Bălți'],
    'Tiraspol': ['Tiraspol'],
    'Krakow': ['Kraków', 'Krakow'],
    'Wroclaw': ['Wrocław'],
    'Poznan': ['Poznań'],
    'Lodz': ['Łódź'],
    'Bialystok': ['Białystok'],
    'Gdansk': ['Gdańsk'],
    'Kosice': ['Košice'],
    'Torun': ['Toruń'],
    'Malaga': ['Málaga'],
    'Cordoba': ['Córdoba'],
    'Delhi': ['New Delhi', 'Delhi'],
    'Odessa': ['Odesa', 'Odessa'],
    'Molodechno': ['Maladzyechna', 'Molodechno'],
    'Baranavichy': ['Baranovichi', 'Baranavichy'],
    'Novopolotsk': ['Navapolatsk', 'Novopolotsk'],
    'Soligorsk': ['Salihorsk'],
    'Yangon': ['Yangon', 'Rangoon'],
    'Mumbai': ['Mumbai', 'Bombay'],
    'Kolkata': ['Kolkata', 'Calcutta'],
    'Chennai': ['Chennai', 'Madras'],
    'Bangalore': ['Bangalore', 'Bengaluru'],
    'Grodno': ['Hrodna', 'Grodno'],
    'Brest': ['Brest', 'Brest (Брэст)'],
    'Hamilton NZ': ['Hamilton'],
    'London ON': ['London'],
    'Victoria BC': ['Victoria'],
    'San José CR': ['San José', 'San Jose'],
}

# The same for the world-cities list, which has its own set.
CITY_ALIASES_WORLD_PAGE = {
    'Salihorsk': ['Soligorsk'],
    'Delhi': ['New Delhi'],
    'Odessa': ['Odesa'],
    'Krakow': ['Kraków'],
    'Molodechno': ['Maladzyechna'],
    'Baranavichy': ['Baranovichi'],
    'Yangon': ['Yangon', 'Rangoon'],
    'Mumbai': ['Mumbai', 'Bombay'],
    'Kolkata': ['Kolkata', 'Calcutta'],
    'Chennai': ['Chennai', 'Madras'],
    'Bangalore': ['Bangalore', 'Bengaluru'],
    'Grodno': ['Hrodna'],
    'Chisinau': ['Chișinău', 'Chisinau'],
    'Kishinev': ['Chișinău'],
    'Wroclaw': ['Wrocław'],
    'Poznan': ['Poznań'],
    'Gdansk': ['Gdańsk'],
    'Brest': ['Brest', 'Brest (Брэст)'],
    'Soligorsk': ['Salihorsk'],
    'Novopolotsk': ['Navapolatsk'],
}

# Country -> flag shown beside a companion.
COUNTRY_FLAG = {
    'Albania': '🇦🇱',
    'Andorra': '🇦🇩',
    'Armenia': '🇦🇲',
    'Australia': '🇦🇺',
    'Austria': '🇦🇹',
    'Azerbaijan': '🇦🇿',
    'Bahrain': '🇧🇭',
    'Bangladesh': '🇧🇩',
    'Belarus': '🇧🇾',
    'Belgium': '🇧🇪',
    'Bolivia': '🇧🇴',
    'Bosnia and Herzegovina': '🇧🇦',
    'Brazil': '🇧🇷',
    'Brunei': '🇧🇳',
    'Bulgaria': '🇧🇬',
    'Cambodia': '🇰🇭',
    'Canada': '🇨🇦',
    'Chile': '🇨🇱',
    'China': '🇨🇳',
    'Colombia': '🇨🇴',
    'Costa Rica': '🇨🇷',
    'Croatia': '🇭🇷',
    'Cuba': '🇨🇺',
    'Cyprus': '🇨🇾',
    'Czechia': '🇨🇿',
    'Czech Republic': '🇨🇿',
    'Denmark': '🇩🇰',
    'Ecuador': '🇪🇨',
    'Egypt': '🇪🇬',
    'El Salvador': '🇸🇻',
    'Estonia': '🇪🇪',
    'Ethiopia': '🇪🇹',
    'Finland': '🇫🇮',
    'France': '🇫🇷',
    'Georgia': '🇬🇪',
    'Germany': '🇩🇪',
    'Ghana': '🇬🇭',
    'Greece': '🇬🇷',
    'Guatemala': '🇬🇹',
    'Holy See (Vatican City State)': '🇻🇦',
    'Honduras': '🇭🇳',
    'Hong Kong': '🇭🇰',
    'Hungary': '🇭🇺',
    'Iceland': '🇮🇸',
    'India': '🇮🇳',
    'Indonesia': '🇮🇩',
    'Iran': '🇮🇷',
    'Iraq': '🇮🇶',
    'Ireland': '🇮🇪',
    'Israel': '🇮🇱',
    'Italy': '🇮🇹',
    'Japan': '🇯🇵',
    'Jordan': '🇯🇴',
    'Kazakhstan': '🇰🇿',
    'Kenya': '🇰🇪',
    'Kosovo': '🇽🇰',
    'Kuwait': '🇰🇼',
    'Kyrgyzstan': '🇰🇬',
    'Laos': '🇱🇦',
    'Latvia': '🇱🇻',
    'Lebanon': '🇱🇧',
    'Liechtenstein': '🇱🇮',
    'Lithuania': '🇱🇹',
    'Luxembourg': '🇱🇺',
    'Macao': '🇲🇴',
    'Macau': '🇲🇴',
    'Malaysia': '🇲🇾',
    'Maldives': '🇲🇻',
    'Malta': '🇲🇹',
    'Mexico': '🇲🇽',
    'Moldova': '🇲🇩',
    'Monaco': '🇲🇨',
    'Mongolia': '🇲🇳',
    'Montenegro': '🇲🇪',
    'Morocco': '🇲🇦',
    'Myanmar': '🇲🇲',
    'Nepal': '🇳🇵',
    'Netherlands': '🇳🇱',
    'New Zealand': '🇳🇿',
    'Nigeria': '🇳🇬',
    'North Macedonia': '🇲🇰',
    'Norway': '🇳🇴',
    'Oman': '🇴🇲',
    'Pakistan': '🇵🇰',
    'Panama': '🇵🇦',
    'Paraguay': '🇵🇾',
    'Peru': '🇵🇪',
    'Philippines': '🇵🇭',
    'Poland': '🇵🇱',
    'Portugal': '🇵🇹',
    'Qatar': '🇶🇦',
    'Romania': '🇷🇴',
    'Russia': '🇷🇺',
    'Saudi Arabia': '🇸🇦',
    'Serbia': '🇷🇸',
    'Singapore': '🇸🇬',
    'Slovakia': '🇸🇰',
    'Slovenia': '🇸🇮',
    'South Africa': '🇿🇦',
    'South Korea': '🇰🇷',
    'Spain': '🇪🇸',
    'Sri Lanka': '🇱🇰',
    'Sweden': '🇸🇪',
    'Switzerland': '🇨🇭',
    'Syria': '🇸🇾',
    'Taiwan': '🇹🇼',
    'Tajikistan': '🇹🇯',
    'Tanzania': '🇹🇿',
    'Thailand': '🇹🇭',
    'Türkiye': '🇹🇷',
    'Turkey': '🇹🇷',
    'Turkmenistan': '🇹🇲',
    'Uganda': '🇺🇬',
    'Ukraine': '🇺🇦',
    'United Arab Emirates': '🇦🇪',
    'UAE': '🇦🇪',
    'United Kingdom': '🇬🇧',
    'United States': '🇺🇸',
    'Uruguay': '🇺🇾',
    'Uzbekistan': '🇺🇿',
    'Venezuela': '🇻🇪',
    'Vietnam': '🇻🇳',
    'Zimbabwe': '🇿🇼',
}
DEFAULT_FLAG = '🌍'

# Local-name continent labels.
CONTINENT_NAMES = {
    'AS': 'Asia',
    'EU': 'Europe',
    'NA': 'North America',
    'SA': 'South America',
    'AF': 'Africa',
    'OC': 'Oceania',
}

# WMO weather code -> (icon, description).
WEATHER_CODES = {
    0: ('☀️', 'Clear'),
    1: ('🌤️', 'Mainly clear'),
    2: ('⛅', 'Partly cloudy'),
    3: ('☁️', 'Overcast'),
    45: ('🌫️', 'Fog'),
    48: ('🌫️', 'Icy fog'),
    51: ('🌦️', 'Light drizzle'),
    53: ('🌦️', 'Drizzle'),
    55: ('🌧️', 'Heavy drizzle'),
    61: ('🌧️', 'Light rain'),
    63: ('🌧️', 'Rain'),
    65: ('🌧️', 'Heavy rain'),
    71: ('🌨️', 'Light snow'),
    73: ('❄️', 'Snow'),
    75: ('❄️', 'Heavy snow'),
    77: ('🌨️', 'Snow grains'),
    80: ('🌦️', 'Rain showers'),
    81: ('🌧️', 'Rain showers'),
    82: ('⛈️', 'Violent showers'),
    85: ('🌨️', 'Snow showers'),
    86: ('❄️', 'Heavy snow showers'),
    95: ('⛈️', 'Thunderstorm'),
    96: ('⛈️', 'Thunderstorm+hail'),
    99: ('⛈️', 'Thunderstorm+hail'),
}

# Home-city categories where a journey starts or ends.
TRANSPORT_HUBS = [
    'Rail Station', 'Train Station', 'Airport', 'Light Rail Station',
    'Bus Station', 'Bus Terminal', 'Ferry Terminal',
]

# Categories of a same-day departure without a hub.
DEPARTURE_SERVICES = ['Transportation Service', 'Bus Line', 'Parking']
DEPARTURE_FUEL = 'Fuel Station'

# Outdoor categories a bicycle trip may start from in the home city.
BICYCLE_START = [
    'Sports and Recreation', 'Road', 'Bridge', 'River', 'Lake',
    'Waterfall', 'Park', 'Trail', 'Bike Trail', 'Other Great Outdoors',
    'Beach', 'Reservoir', 'Bike Rental',
]

# Categories that end the search for the way home.
NIGHTLIFE = [
    'Bar', 'Beach Bar', 'Beer Bar', 'Brewery', 'Cocktail Bar',
    'Dive Bar', 'Gastropub', 'Hookah Bar', 'Hotel Bar', 'Irish Pub',
    'Karaoke Bar', 'Lounge', 'Night Club', 'Pub', 'Rock Club',
    'Sports Bar', 'Whisky Bar', 'Wine Bar',
]

# Stops in other cities that still belong to the drive home.
ROADSIDE = [
    'Fuel Station', 'Gas Station', 'Rest Stop', 'Truck Stop', 'Road', 'Highway',
]

# Arrival categories at home.
HOME_CATEGORY = 'Home (private)'
NEIGHBORHOOD_CATEGORY = 'Neighborhood'

# Category -> transport icon, and which icon wins.
TRANSPORT_ICONS = {
    'Airport': '✈️',
    'Light Rail Station': '✈️',
    'Rail Station': '🚂',
    'Train Station': '🚂',
    'Bus Station': '🚌',
    'Bus Terminal': '🚌',
    'Ferry Terminal': '⛴️',
    'Fuel Station': '🚗',
    'Gas Station': '🚗',
    'Parking': '🚗',
}
ICON_RANK = {'✈️': 4, '🚂': 3, '⛴️': 2, '🚌': 1, '🚗': 0}
NAME_ICONS = ['✈️', '🚂', '🚌', '🚗', '⛺', '🛁', '⛴️']
