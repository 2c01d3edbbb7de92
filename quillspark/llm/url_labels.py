"""A small labelled URL table: names made up for training, none of a real site."""

BLOCKED = (
    "http://casino-bonus.example.com/en/12",
    "https://blog.casino-bonus.example.org",
    "http://m.best-casino.example.org/fr/345",
    "https://www.best-casino.invalid/index.html",
    "http://www.casino-win.invalid/de/678/",
    "https://casino-win.example.net/en/910/",
    "http://blog.online-casino.example.net/es/9.html",
    "https://m.online-casino.test/fr/77.html",
    "http://m.free-bets.test/",
    "https://www.free-bets.example.com/fr/345",
    "http://bets-now.example.com/index.html",
    "https://blog.bets-now.example.org/de/678/",
    "http://blog.bet-win-big.example.org/en/910/",
    "https://m.bet-win-big.invalid/es/9.html",
    "http://www.sports-bets.invalid/fr/77.html",
    "https://sports-bets.example.net/",
    "http://cheap-pills.example.net/en/12",
    "https://blog.cheap-pills.test",
    "http://m.buy-cheap-pills.test/de/678/",
    "https://www.buy-cheap-pills.example.com/en/910/",
    "http://www.pills-online.example.com/es/9.html",
    "https://pills-online.example.org/fr/77.html",
    "http://blog.cheap-meds.example.org/",
    "https://m.cheap-meds.invalid/en/12",
    "http://m.spam-farm.invalid",
    "https://www.spam-farm.example.net/fr/345",
    "http://link-spam.example.net/index.html",
    "https://blog.link-spam.test/es/9.html",
    "http://blog.seo-farm.test/fr/77.html",
    "https://m.seo-farm.example.com/",
    "http://www.link-farm.example.com/en/12",
    "https://link-farm.example.org",
    "http://ads-track.example.org/fr/345",
    "https://blog.ads-track.invalid/index.html",
    "http://m.ad-tracker.invalid/de/678/",
    "https://www.ad-tracker.example.net/en/910/",
    "http://www.track-ads.example.net/",
    "https://track-ads.test/en/12",
    "http://blog.popup-ads.test",
    "https://m.popup-ads.example.com/fr/345",
    "http://m.ads-click.example.com/index.html",
    "https://www.ads-click.example.org/de/678/",
    "http://free-prizes.example.org/en/910/",
    "https://blog.free-prizes.invalid/es/9.html",
    "http://blog.win-cash.invalid/fr/77.html",
    "https://m.win-cash.example.net",
    "http://www.free-spins.example.net/fr/345",
    "https://free-spins.test/index.html",
    "http://win-prizes.test/de/678/",
    "https://blog.win-prizes.example.com/en/910/",
    "http://m.adult-cams.example.com/es/9.html",
    "https://www.adult-cams.example.org/fr/77.html",
    "http://www.porn-tube.example.org/",
    "https://porn-tube.invalid/en/12",
    "http://blog.xxx-videos.invalid/index.html",
    "https://m.xxx-videos.example.net/de/678/",
    "http://m.payday-loans.example.net/en/910/",
    "https://www.payday-loans.test/es/9.html",
    "http://replica-watches.test/fr/77.html",
    "https://blog.replica-watches.example.com/",
    "http://blog.viagra-shop.example.com/en/12",
    "https://m.viagra-shop.example.org",
    "http://www.crack-keygen.example.org/fr/345",
    "https://crack-keygen.invalid/en/910/",
    "http://free-money.invalid/es/9.html",
    "https://blog.free-money.example.net/fr/77.html",
    "http://m.get-rich-fast.example.net/",
    "https://www.get-rich-fast.test/en/12",
    "http://www.lottery-win.test",
    "https://lottery-win.example.com/fr/345",
    "http://blog.slots-jackpot.example.com/index.html",
    "https://m.slots-jackpot.example.org/de/678/",
    "http://m.poker-bonus.example.org/fr/77.html",
    "https://www.poker-bonus.invalid/",
    "http://casino-slots.invalid/en/12",
    "https://blog.casino-slots.example.net",
    "http://blog.cheap-viagra.example.net/fr/345",
    "https://m.cheap-viagra.test/index.html",
    "http://www.pills-discount.test/de/678/",
    "https://pills-discount.example.com/en/910/",
    "http://tracking-ads.example.com/es/9.html",
    "https://blog.tracking-ads.example.org/en/12",
    "http://m.spam-links.example.org",
    "https://www.spam-links.invalid/fr/345",
    "http://www.clickbait-farm.invalid/index.html",
    "https://clickbait-farm.example.net/de/678/",
)

ALLOWED = (
    "http://window-garden.example.com/en/12",
    "https://blog.window-garden.example.org",
    "http://m.winter-sports.example.org/fr/345",
    "https://www.winter-sports.invalid/index.html",
    "http://www.alphabet-school.invalid/de/678/",
    "https://alphabet-school.example.net/en/910/",
    "http://blog.betterhealth.example.net/es/9.html",
    "https://m.betterhealth.test/fr/77.html",
    "http://m.road-maps.test/",
    "https://www.road-maps.example.com/fr/345",
    "http://uploads.example.com/index.html",
    "https://blog.uploads.example.org/de/678/",
    "http://blog.library-online.example.org/en/910/",
    "https://m.library-online.invalid/es/9.html",
    "http://www.city-library.invalid/fr/77.html",
    "https://city-library.example.net/",
    "http://university-press.example.net/en/12",
    "https://blog.university-press.test",
    "http://m.science-daily.test/de/678/",
    "https://www.science-daily.example.com/en/910/",
    "http://www.open-history.example.com/es/9.html",
    "https://open-history.example.org/fr/77.html",
    "http://blog.museum-guide.example.org/",
    "https://m.museum-guide.invalid/en/12",
    "http://m.weather-report.invalid",
    "https://www.weather-report.example.net/fr/345",
    "http://recipe-book.example.net/index.html",
    "https://blog.recipe-book.test/es/9.html",
    "http://blog.train-times.test/fr/77.html",
    "https://m.train-times.example.com/",
    "http://www.music-school.example.com/en/12",
    "https://music-school.example.org",
    "http://farmhouse-bread.example.org/fr/345",
    "https://blog.farmhouse-bread.invalid/index.html",
    "http://m.family-farm.invalid/de/678/",
    "https://www.family-farm.example.net/en/910/",
    "http://www.tracks-and-trails.example.net/",
    "https://tracks-and-trails.test/en/12",
    "http://blog.running-track.test",
    "https://m.running-track.example.com/fr/345",
    "http://m.freedom-forum.example.com/index.html",
    "https://www.freedom-forum.example.org/de/678/",
    "http://freesoftware.example.org/en/910/",
    "https://blog.freesoftware.invalid/es/9.html",
    "http://blog.cheaper-energy-advice.invalid/fr/77.html",
    "https://m.cheaper-energy-advice.example.net",
    "http://www.local-news.example.net/fr/345",
    "https://local-news.test/index.html",
    "http://daily-news.test/de/678/",
    "https://blog.daily-news.example.com/en/910/",
    "http://m.health-advice.example.com/es/9.html",
    "https://www.health-advice.example.org/fr/77.html",
    "http://www.travel-notes.example.org/",
    "https://travel-notes.invalid/en/12",
    "http://blog.cinema-review.invalid/index.html",
    "https://m.cinema-review.example.net/de/678/",
    "http://m.book-club.example.net/en/910/",
    "https://www.book-club.test/es/9.html",
    "http://chess-club.test/fr/77.html",
    "https://blog.chess-club.example.com/",
    "http://blog.gardening.example.com/en/12",
    "https://m.gardening.example.org",
    "http://www.language-course.example.org/fr/345",
    "https://language-course.invalid/en/910/",
    "http://maths-help.invalid/es/9.html",
    "https://blog.maths-help.example.net/fr/77.html",
    "http://m.physics-notes.example.net/",
    "https://www.physics-notes.test/en/12",
    "http://www.translation.test",
    "https://translation.example.com/fr/345",
    "http://blog.theatre.example.com/index.html",
    "https://m.theatre.example.org/de/678/",
    "http://m.thatcher.example.org/fr/77.html",
    "https://www.thatcher.invalid/",
    "http://nation.invalid/en/12",
    "https://blog.nation.example.net",
    "http://blog.station.example.net/fr/345",
    "https://m.station.test/index.html",
    "http://www.rotation.test/de/678/",
    "https://rotation.example.com/en/910/",
    "http://therapist.example.com/es/9.html",
    "https://blog.therapist.example.org/en/12",
    "http://m.interior.example.org",
    "https://www.interior.invalid/fr/345",
    "http://www.heather.invalid/index.html",
    "https://heather.example.net/de/678/",
    "http://blog.thorium.example.net/en/910/",
    "https://m.thorium.test/es/9.html",
    "http://m.entry.test/fr/77.html",
    "https://www.entry.example.com/",
    "http://thinner.example.com/fr/345",
    "https://blog.thinner.example.org/index.html",
    "http://blog.athlete.example.org/de/678/",
    "https://m.athlete.invalid/en/910/",
    "http://www.reader.invalid/es/9.html",
    "https://reader.example.net/fr/77.html",
    "http://tender.example.net/",
    "https://blog.tender.test/en/12",
)
